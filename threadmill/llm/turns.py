"""Conversation structure repair: faults by windows, then a fold over sorted turns that carries the cheapest edits for
each state the conversation can be in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .common import table

#: What edits cost, and what a truncated turn adds that is not deleted.
REROLE, DELETE, INSERT, CUT = 3, 4, 3, 3
#: Dearer than any repair: a state that can't be reached.
NEVER = 1 << 50
#: Turn numbers of a block are equal but for so many low bits: longer conversations are folded block by block.
BLOCK_BITS = 8
SPACES = " \t\n\v\f\r"
#: Faults, in the order in which they count.
NONE, BLANK, DUPLICATE, TRUNCATED = range(4)
#: States: nothing yet, after a system turn, after a user's, after an assistant's.
STATES = ("e", "s", "u", "a")


def damaged(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, gone): rows harmed by the hash of their place, as a test of the repair asks for. Null
    roles and texts are one space, and so are null ids and turns where they are hashed. A dropped row stays with gone
    set, so that its conversation is known; a repeated one comes twice."""
    blank = F.lit(" ")
    place = F.concat(F.coalesce(F.col("conv_id").cast("string"), blank), F.lit(":"), F.coalesce(F.col("turn").cast("string"), blank))
    rows = turns.select("conv_id", "turn", F.coalesce("role", blank).alias("role"), F.coalesce("text", blank).alias("text"), (F.crc32(place) % 20).alias("harm"))
    text = F.when(F.col("harm") == 1, "").when(F.col("harm") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    rows = rows.select("conv_id", "turn", F.when(F.col("harm") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), (F.col("harm") == 0).alias("gone"), F.when(F.col("harm") == 3, 2).otherwise(1).alias("times"))
    return rows.withColumn("copy", F.explode(F.sequence(F.lit(1), "times"))).drop("times", "copy")


def faults(turns: DataFrame) -> DataFrame:
    """turns with fault: the first of blank, duplicate (role and text seen earlier in the conversation), truncated."""
    seen = Window.partitionBy("conv_id", "gone", "role", "text").orderBy("turn")
    trimmed = F.rtrim(F.col("text"), F.lit(SPACES))
    fault = F.when(trimmed == "", BLANK).when(F.row_number().over(seen) > 1, DUPLICATE).when(F.right(trimmed, F.lit(1)).isin(".", "!", "?"), NONE).otherwise(TRUNCATED)
    return turns.withColumn("fault", fault)


def _best(cost: Column, audit: Column) -> Column:
    return F.struct(cost.cast("long").alias("cost"), audit.alias("audit"))


def _then(x: Column, cost: Column | int, letter: Column | str) -> Column:
    """x with one more edit."""
    letter = F.lit(letter) if isinstance(letter, str) else letter
    return _best(x["cost"] + cost, F.concat(x["audit"], letter))


def _states(e: Column, s: Column, u: Column, a: Column) -> Column:
    return F.struct(e.alias("e"), s.alias("s"), u.alias("u"), a.alias("a"))


def _let(value: Column, body) -> Column:
    """body of value, which is computed once."""
    return F.transform(F.array(value), body)[0]


def _inserted(x: Column) -> Column:
    """The states of x, or after a user's and perhaps an assistant's turn that are inserted."""
    user = F.least(x["u"], *(_then(x[k], INSERT, "I") for k in ("e", "s", "a")))
    return _let(user, lambda u: _states(x["e"], x["s"], u, F.least(x["a"], _then(u, INSERT, "I"))))


def _turn(x: Column, row: Column) -> Column:
    """The states after one more turn: it is deleted, kept, or gets the other role."""
    must_go = row["fault"].isin(BLANK, DUPLICATE)
    extra = F.when(row["fault"] == TRUNCATED, CUT).otherwise(0)

    def taken(before: Column, role: str, rerole: bool = True) -> Column:
        same = row["initial"] == role
        never = _best(F.lit(NEVER), F.lit(""))
        put = _then(before, extra + F.when(same, 0).otherwise(REROLE), F.when(same, "K").otherwise("R"))
        return F.when(must_go if rerole else must_go | ~same, never).otherwise(put)

    gone = {k: _then(x[k], DELETE, "D") for k in STATES}
    after = _states(
        gone["e"],
        F.least(gone["s"], taken(x["e"], "s", rerole=False)),
        F.least(gone["u"], taken(F.least(x["e"], x["s"], x["a"]), "u")),
        F.least(gone["a"], taken(x["u"], "a")),
    )
    return _let(after, _inserted)


def _from(state: Column) -> Column:
    """Only the state of this number is reached, at no cost."""
    return _states(*(_best(F.when(state == k, 0).otherwise(NEVER), F.lit("")) for k in range(4)))


def _chained(x: Column, block: Column) -> Column:
    """The states after a block, from those before it (an array of cost, audit, path) and the block's table of what it
    costs to go from state to state. path has the state before each block."""

    def to(k: str) -> Column:
        ways = [(x[i], block["ways"][i][k]) for i in range(4)]
        return F.least(*(F.struct((b["cost"] + w["cost"]).alias("cost"), F.concat(b["audit"], w["audit"]).alias("audit"), F.concat(b["path"], F.lit(str(i))).alias("path")) for i, (b, w) in enumerate(ways)))

    return F.array(*(to(k) for k in STATES))


def _letters(s: Column) -> Column:
    return F.when(F.length(s) == 0, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), F.length(s)), lambda i: F.substr(s, i, F.lit(1))))


#: Inserted turns by which a conversation gets to a state before its first row.
_AHEAD = ("", "", "I", "II")


def _rebuilt(rows: Column, state: Column, audit: Column) -> Column:
    """The turns that edits leave of a block's rows, where they begin in a state (by number)."""

    def edit(x: Column, letter: Column) -> Column:
        row = F.get(rows, x["at"])
        next_role = F.when(x["state"] == 2, "assistant").otherwise("user")
        keep = letter == "K"
        role = F.when(keep, row["role"]).otherwise(next_role)
        initial = F.substring(role, 1, 1)
        text = F.when(letter == "I", "").otherwise(row["text"])
        state = F.when(letter == "D", x["state"]).when(initial == "s", 1).when(initial == "u", 2).otherwise(3)
        out = F.when(letter == "D", x["out"]).otherwise(F.concat(x["out"], F.array(F.struct(role.alias("role"), text.alias("text")))))
        return F.struct(state.alias("state"), (x["at"] + F.when(letter == "I", 0).otherwise(1)).alias("at"), out.alias("out"))

    start = F.struct(state.cast("int").alias("state"), F.lit(0).alias("at"), F.array().cast("array<struct<role:string,text:string>>").alias("out"))
    return F.aggregate(_letters(audit), start, edit, lambda x: x["out"])


def repaired(turns: DataFrame) -> DataFrame:
    """One row per conv_id of turns (conv_id, turn, role, text, gone): gaps, blank, duplicate, truncated, illegal, cost,
    audit, repaired (an array of role and text).

    Rows of a conversation are taken by turn, nulls first; rows that share a turn by role and text. Rows with gone set
    are absent, but their conversation has a result: zeros and no turns where nothing is left. Edits are Keep, Rerole,
    Delete and Insert; audit has the initials of the cheapest that give the roles' initials the form (s?(ua)+)?, and of
    equally cheap ones those first in ASCII. An audit and its rows tell the cost, so an audit that begins another is
    cheaper than it: the least of a state stays the least whatever follows. Null ids are one conversation. Null roles
    and texts are one space. A role is judged by its first character, and an empty one has a space for it. Extra
    columns are ignored; an empty table gives an empty result.

    The fold runs over blocks of turns, from each of the four states, and a second one over the blocks' tables, so
    that a conversation of any length is folded in many tasks; only its audit and its repaired text are put together
    in one row. What shares a conversation and one turn number is one block."""
    blank = F.lit(" ")
    rows = turns.select("conv_id", "turn", F.coalesce("role", blank).alias("role"), F.coalesce("text", blank).alias("text"), F.coalesce("gone", F.lit(False)).alias("gone"))
    rows = faults(rows)
    initial = F.when(F.col("role") == "", " ").otherwise(F.substring("role", 1, 1))
    # of rows alike in turn, role and text the one that is no duplicate comes first
    there = F.when(~F.col("gone"), F.struct("turn", "role", "text", (F.col("fault") == DUPLICATE).alias("again"), "fault", initial.alias("initial")))
    blocks = rows.groupBy("conv_id", F.shiftright("turn", BLOCK_BITS).alias("block")).agg(
        F.sort_array(F.collect_list(there)).alias("rows"),
        *(F.count(F.when(~F.col("gone") & (F.col("fault") == k), 1)).alias(name) for k, name in ((BLANK, "blank"), (DUPLICATE, "duplicate"), (TRUNCATED, "truncated"))),
    )
    numbers = F.filter(F.transform("rows", lambda r: r["turn"]), lambda t: t.isNotNull())
    ways = F.transform(F.array(*(F.lit(k) for k in range(4))), lambda k: F.aggregate("rows", _from(k), _turn))
    blocks = blocks.withColumns({"ways": ways, "turns": F.array_distinct(numbers)})
    block = F.struct("block", "ways", F.transform("rows", lambda r: F.struct(r["role"].alias("role"), r["text"].alias("text"), r["initial"].alias("initial"))).alias("rows"))
    convs = blocks.groupBy("conv_id").agg(
        F.sort_array(F.collect_list(block)).alias("blocks"), F.max(F.array_max("turns")).alias("last"), F.min(F.array_min("turns")).alias("first"), F.sum(F.size("turns")).alias("n"),
        *(F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")),
    )
    begin = _inserted(_from(F.lit(0)))
    begin = _let(begin, lambda x: F.array(*(F.struct(x[k]["cost"].alias("cost"), x[k]["audit"].alias("audit"), F.lit("").alias("path")) for k in STATES)))
    done = F.aggregate("blocks", begin, _chained)
    # a repair ends with nothing or after an assistant's turn
    ends = [F.struct(*(F.col("done")[k][c].alias(c) for c in ("cost", "audit")), F.concat(F.col("done")[k]["path"], F.lit(str(k))).alias("path")) for k in (0, 3)]
    initials = F.flatten(F.transform("blocks", lambda b: F.transform(b["rows"], lambda r: r["initial"])))
    out = convs.withColumn("done", done).withColumns({"best": F.least(*ends), "initials": initials})
    legal = F.array(F.lit("su"), F.lit("ua"), F.lit("au"))
    illegal = F.size(F.filter("initials", lambda x, i: (i > 0) & ~F.array_contains(legal, F.concat(F.get(F.col("initials"), i - 1), x))))

    def part(b: Column, i: Column) -> Column:
        state, end = (F.substr(F.col("best.path"), i + k, F.lit(1)).cast("int") for k in (1, 2))
        audit = F.get(b["ways"], state)
        audit = F.element_at(F.array(*(audit[k]["audit"] for k in STATES)), end + 1)
        ahead = F.element_at(F.array(*(F.lit(x) for x in _AHEAD)), state + 1)
        return F.when(i == 0, _rebuilt(b["rows"], F.lit(0), F.concat(ahead, audit))).otherwise(_rebuilt(b["rows"], state, audit))

    return out.select(
        "conv_id", F.coalesce(F.col("last") - F.col("first") + 1 - F.col("n"), F.lit(0)).cast("long").alias("gaps"), "blank", "duplicate", "truncated", illegal.cast("long").alias("illegal"),
        F.col("best.cost").alias("cost"), F.col("best.audit").alias("audit"), F.flatten(F.transform("blocks", part)).alias("repaired"),
    )


def op13_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The operator over damaged conversations, with the repaired turns as a digest."""
    out = repaired(damaged(table(spark, sf_dir, "conversations")))
    text = F.array_join(F.transform("repaired", lambda r: F.concat(r["role"], F.lit(":"), r["text"])), "\n")
    return out.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", F.sha2(text, 256).alias("repaired_sha256"))
