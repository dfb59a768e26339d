import regex
from threadmill.llm import bpe


def digests(df):
    return sorted((r.doc_id is None, r.doc_id or 0, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in df.collect())


def expected(df):
    return sorted((r.doc_id is None, r.doc_id or 0, *bpe.reference_digest(r.text or "", bpe.ranks_path())) for r in df.select("doc_id", "text").collect())


def test_whole_table_as_tiktoken(docs):
    assert digests(bpe.bpe_digests(docs, bpe.ranks_path())) == expected(docs)


def test_small_chunks_give_the_same(spark, docs, odd):
    some = docs.where("doc_id < 60").select("doc_id", "text").unionByName(odd.select("doc_id", "text"))
    hard = [(100, "a" * 3000 + " b"), (101, "'ll " * 300 + "\n\n \n x  y"), (102, " " * 700 + "z" + "　" * 300 + "é\U0001f600" * 200), (103, "\n\nb  c" * 400)]
    some = some.unionByName(spark.createDataFrame(hard, "doc_id long, text string"))
    for chunk, overlap in ((64, 16), (500, 100)):
        assert digests(bpe.bpe_digests(some, bpe.ranks_path(), chunk=chunk, overlap=overlap)) == expected(some)


def test_empty_table_and_round_trip(spark, none, odd):
    assert bpe.bpe_digests(none, bpe.ranks_path()).count() == 0
    ids = bpe.encode_texts(odd.na.fill("", ["text"]), ["doc_id"], bpe.ranks_path())
    for r in bpe.decode_ids(ids.drop("decoded").join(odd.na.fill("", ["text"]).select("doc_id", "text").distinct(), "doc_id"), bpe.ranks_path()).collect():
        assert bytes(r.decoded) == r.text.encode()


def test_boundaries_are_true_boundaries():
    import public_tokenizers

    text = "Hello  there, it's 12  o'clock\n\n  now"
    every = {m.start() for m in regex.finditer(public_tokenizers.PATTERN, text)}
    assert set(bpe.boundaries(text, True)) <= every
