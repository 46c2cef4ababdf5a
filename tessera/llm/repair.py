"""Repair of conversation structure by folds over sorted turns in Spark SQL's own functions.

A repaired conversation's role initials are ``(s?(ua)+)?``. Four states say what has been given so far: nothing, a system
turn, a user turn, an assistant turn. ``aggregate()`` carries for each of them the cheapest edits that lead there, as a struct
(cost, audit), from turn to turn; ``least`` on structs takes the cheaper one and, among equals, the ASCII-least audit. Two
audits of the same cost over the same turns are never prefixes of one another (what one has more could only be inserts, which
cost), so the least audit of a conversation consists of least audits of its parts.

No task holds a conversation turn by turn: turns are collected in blocks of ``BLOCK``. A block's fold begins at each state it
may be entered in, and a second fold over a conversation's blocks chooses among those 4 x 4 results. Conversations with more
than ``1 / HOT`` of all turns (at most ``HOT`` of them, so they are broadcast) get their blocks from positions over range
partitions, the others from a window. What a conversation returns, its audit and the digest of its repaired text, needs both as
one value each; so Spark's limit for one value, 2 GB, is the limit for a repaired conversation.

Nulls: a null role or text counts as one space, so such a text is blank and such a role illegal; a null conv_id is a
conversation of its own, a null turn comes first and counts in no gap. Turns with the same number are taken in order of role and
a digest of role and text. Empty texts are blank. Texts of any length are read whole. Repeated rows are duplicates like others.
Further columns, whatever their names, play no part. Empty table: no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.common import materialize
from tessera.operators.durable import running

#: Turns of a block.
BLOCK = 512
#: A conversation with more than this part of all turns is dealt over several tasks.
HOT = 1024
#: Costs: another role, a deletion, an insertion, keeping a truncated turn.
REROLE, DELETE, INSERT, CUT = 2, 3, 2, 1
#: The cost of what cannot be.
FAR = 1 << 40
_EDITS = "struct<cost: bigint, audit: string>"
_PATH = "struct<cost: bigint, audits: array<string>, states: array<int>>"
_VISIBLE = r"[^\x20\x09-\x0D]"


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, key): turns by the checksum of their key dropped, emptied, cut, repeated or given to the user."""
    c = conversations.select("conv_id", F.col("turn").alias("_turn"), *(F.coalesce(F.col(x).cast("string"), F.lit(" ")).alias(x) for x in ("role", "text")))
    key = F.concat_ws(":", *(F.coalesce(F.col(x).cast("string"), F.lit(" ")) for x in ("conv_id", "_turn")))
    c = c.withColumn("lot", F.crc32(key.cast("binary")) % 20).filter("lot <> 0")
    lot = F.col("lot")
    c = c.select(
        "conv_id",
        F.col("_turn").cast("long").alias("turn"),
        F.when(lot == 4, F.lit("user")).otherwise(F.col("role")).alias("role"),
        F.when(lot == 1, F.lit("")).when(lot == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        F.explode(F.when(lot == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("_copy"),
    ).drop("_copy")
    return c.withColumn("key", F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256))


def _faults(rows: DataFrame) -> DataFrame:
    """Turns with their first fault: b(lank), d(uplicate, where ``again``), t(runcated) or none."""
    fault = F.when(~F.col("text").rlike(_VISIBLE), F.lit("b")).when(F.col("again"), F.lit("d"))
    return rows.withColumn("fault", fault.when(~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z"), F.lit("t")).otherwise(F.lit("")))


def blocks(turns: DataFrame, block: int = BLOCK, hot: int = HOT) -> DataFrame:
    """(conv_id, block, full, rows): blocks of turns in order; ``full`` if a block need not be its conversation's first."""
    order = [F.col("turn").asc_nulls_first(), F.col("role"), F.col("key")]
    turns = materialize(turns.sparkSession, turns, "turns")
    sizes = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    total = turns.count()
    large = sizes.filter(F.col("n") > max(total // hot, 1)).select(F.col("conv_id").alias("_large"))
    large = F.broadcast(materialize(turns.sparkSession, large, "large"))  # at most ``hot`` rows hold 1/hot of all turns each
    here = turns["conv_id"].eqNullSafe(large["_large"])
    w, same = Window.partitionBy("conv_id").orderBy(*order), Window.partitionBy("conv_id", "key").orderBy(*order)
    few = turns.join(large, here, "left_anti").withColumns({"again": F.row_number().over(same) > 1, "at": F.row_number().over(w) - 1})
    many = running(turns.join(large, here, "left_semi"), {"at": F.lit(1).cast("long")}, [F.col("conv_id").asc_nulls_first(), *order])
    many = materialize(turns.sparkSession, many, "large-turns")
    first = many.groupBy("conv_id", "key").agg(F.min("at").alias("_first")).toDF("_conv", "_key", "_first").hint("merge")
    many = many.join(first, many["conv_id"].eqNullSafe(first["_conv"]) & (many["key"] == first["_key"])).withColumn("again", F.col("at") > F.col("_first"))

    def cut(rows: DataFrame, full: Column) -> DataFrame:
        rows = _faults(rows).withColumn("block", F.floor(F.col("at") / block).cast("long"))
        turn = F.struct(F.col("at").cast("long").alias("at"), "turn", "role", "text", "fault")
        return rows.groupBy("conv_id", "block").agg(F.sort_array(F.collect_list(turn)).alias("rows")).withColumn("full", full)

    return cut(few, F.col("block") > 0).unionByName(cut(many, F.lit(True)))


def _edits(cost, audit: str) -> Column:
    return F.struct(F.lit(cost).cast("long").alias("cost"), F.lit(audit).alias("audit")).cast(_EDITS)


def _more(edits: Column, cost, audit) -> Column:
    cost, audit = (x if isinstance(x, Column) else F.lit(x) for x in (cost, audit))
    return F.struct((edits["cost"] + cost).alias("cost"), F.concat(edits["audit"], audit).alias("audit")).cast(_EDITS)


def _step(have: Column, turn: Column) -> Column:
    """The four states after one more turn, each reached at least cost; inserts stand before the turn's own edit."""
    s0, s1, s2, s3 = (have[f"s{i}"] for i in range(4))
    user = F.least(s2, *(_more(s, INSERT, "I") for s in (s0, s1, s3)))
    assistant = F.least(s3, _more(s2, INSERT, "I"), *(_more(s, 2 * INSERT, "II") for s in (s0, s1)))
    initial, must_go = F.substring(turn["role"], 1, 1), turn["fault"].isin("b", "d")
    stay = F.when(turn["fault"] == "t", F.lit(CUT)).otherwise(F.lit(0)) + F.when(must_go, F.lit(FAR)).otherwise(F.lit(0))
    drop = lambda s: _more(s, DELETE, "D")

    def give(s: Column, role: str) -> Column:
        right = initial == role
        return _more(s, stay + F.when(right, F.lit(0)).otherwise(F.lit(REROLE)), F.when(right, F.lit("K")).otherwise(F.lit("R")))

    return F.struct(
        drop(s0).alias("s0"),
        F.least(drop(s1), _more(s0, stay + F.when(initial == "s", F.lit(0)).otherwise(F.lit(FAR)), "K")).alias("s1"),
        F.least(drop(user), give(s0, "u"), give(s1, "u"), give(assistant, "u")).alias("s2"),
        F.least(drop(assistant), give(user, "a")).alias("s3"),
    )


def _states(*four: Column) -> Column:
    return F.struct(*(s.alias(f"s{i}") for i, s in enumerate(four)))


def _fold(rows: Column, start: int) -> Column:
    return F.aggregate(rows, _states(*(_edits(0 if i == start else FAR, "") for i in range(4))), _step)


def _summary() -> dict[str, Column]:
    """Figures of a block that add up over blocks, and its ends."""
    rows = F.col("rows")
    number = lambda kind: F.size(F.filter(rows, lambda r: r["fault"] == kind)).cast("long")
    initials = F.transform(rows, lambda r: F.substring(r["role"], 1, 1))
    turns = F.transform(rows, lambda r: r["turn"])
    n = F.size(rows)
    pairs = F.zip_with(F.slice(initials, F.lit(1), n - 1), F.slice(initials, F.lit(2), n - 1), lambda x, y: F.concat(x, y))
    return {
        "blank": number("b"),
        "duplicate": number("d"),
        "truncated": number("t"),
        "illegal": F.size(F.filter(pairs, lambda p: ~p.isin("su", "ua", "au"))).cast("long"),
        "distinct": F.size(F.array_compact(F.array_distinct(turns))).cast("long"),
        "low": F.array_min(turns),
        "high": F.array_max(turns),
        "first_turn": F.element_at(turns, 1),
        "last_turn": F.element_at(turns, -1),
        "first_initial": F.element_at(initials, 1),
        "last_initial": F.element_at(initials, -1),
    }


def _choose(found: Column) -> Column:
    """The cheapest way through all blocks, with the state in which each block is entered."""

    def path(p: Column, j: int, edits: Column) -> Column:
        return F.struct((p["cost"] + edits["cost"]).alias("cost"), F.concat(p["audits"], F.array(edits["audit"])).alias("audits"), F.concat(p["states"], F.array(F.lit(j))).alias("states")).cast(_PATH)

    def step(have: Column, block: Column) -> Column:
        return _states(*(F.least(*(path(have[f"s{j}"], j, block["ways"][j][f"s{t}"]) for j in range(4))) for t in range(4)))

    start = [F.struct(F.lit(0 if i == 0 else FAR).cast("long").alias("cost"), F.array().cast("array<string>").alias("audits"), F.array().cast("array<int>").alias("states")).cast(_PATH) for i in range(4)]

    def end(s: Column) -> Column:
        def with_tail(p: Column, cost: int, tail: str) -> Column:
            return F.struct((p["cost"] + cost).alias("cost"), p["audits"].alias("audits"), F.lit(tail).alias("tail"), p["states"].alias("states"))

        return F.least(with_tail(s["s0"], 0, ""), with_tail(s["s3"], 0, ""), with_tail(s["s2"], INSERT, "I"), with_tail(s["s1"], 2 * INSERT, "II"))

    return F.aggregate(found, _states(*start), step, end)


def _repaired() -> Column:
    """A block's repaired turns as lines, from its turns, their edits and the state it is entered in."""
    tokens = F.regexp_extract_all("audit", F.lit("(I*[KRD])"), F.lit(1))
    item = lambda role, text: F.struct(role.cast("string").alias("role"), text.alias("text"))

    def given(turn: Column, token: Column) -> Column:
        edit = F.substring(token, -1, 1)
        own = F.when(edit == "K", F.array(item(turn["role"], turn["text"]))).when(edit == "R", F.array(item(F.lit(None), turn["text"])))
        return F.concat(F.array_repeat(item(F.lit(None), F.lit("")), F.length(token) - 1), own.otherwise(F.array().cast("array<struct<role: string, text: string>>")))

    items = F.flatten(F.zip_with("rows", tokens, given))
    opens = (F.col("state") == 0) & F.coalesce(F.substring(F.get(items, F.lit(0))["role"], 1, 1) == "s", F.lit(False))
    ahead = F.when((F.col("state") == 2) | opens, F.lit(1)).otherwise(F.lit(0))  # 1: an assistant turn is due at even places
    due = lambda i: F.when((i + ahead) % 2 == 0, F.lit("user")).otherwise(F.lit("assistant"))
    return F.transform(items, lambda x, i: F.concat(F.coalesce(x["role"], due(i)), F.lit(":"), x["text"]))


def repair(conversations: DataFrame, block: int = BLOCK, hot: int = HOT) -> DataFrame:
    """One row for each conv_id: faults, the cheapest edits, and ``repaired``, the repaired turns as ``role:text`` lines."""
    spark = conversations.sparkSession
    cut = materialize(spark, blocks(damaged(conversations), block, hot), "blocks")
    dead = _states(*(_edits(FAR, "") for _ in range(4)))
    rest = [F.when(F.col("full"), _fold(F.col("rows"), i)).otherwise(dead) for i in (1, 2, 3)]
    figures = _summary()
    told = cut.select("conv_id", F.struct("block", F.array(_fold(F.col("rows"), 0), *rest).alias("ways"), *(c.alias(n) for n, c in figures.items())).alias("b"))
    found = told.groupBy("conv_id").agg(F.sort_array(F.collect_list("b")).alias("b"))
    total = lambda name: F.aggregate("b", F.lit(0).cast("long"), lambda a, x: a + x[name])
    seams = lambda test: F.size(F.filter(F.zip_with(F.slice("b", F.lit(1), F.size("b") - 1), F.slice("b", F.lit(2), F.size("b") - 1), test), lambda x: x)).cast("long")
    across = seams(lambda x, y: ~F.concat(x["last_initial"], y["first_initial"]).isin("su", "ua", "au"))
    shared = seams(lambda x, y: F.coalesce(x["last_turn"] == y["first_turn"], F.lit(False)))
    span = F.array_max(F.transform("b", lambda x: x["high"])) - F.array_min(F.transform("b", lambda x: x["low"])) + 1
    chosen = found.select(
        "conv_id",
        F.coalesce(span - (total("distinct") - shared), F.lit(0).cast("long")).alias("gaps"),
        *(total(n).alias(n) for n in ("blank", "duplicate", "truncated")),
        (total("illegal") + across).alias("illegal"),
        _choose(F.col("b")).alias("best"),
        F.transform("b", lambda x: x["block"]).alias("at"),
    )
    chosen = materialize(spark, chosen, "edits")
    parts = chosen.select(F.col("conv_id").alias("_conv"), F.explode(F.arrays_zip("at", F.col("best.audits").alias("audit"), F.col("best.states").alias("state"))).alias("p"))
    parts = parts.select("_conv", F.col("p.at").alias("_block"), F.col("p.audit").alias("audit"), F.col("p.state").alias("state"))
    lines = cut.join(parts.hint("merge"), cut["conv_id"].eqNullSafe(parts["_conv"]) & (cut["block"] == parts["_block"]))
    lines = lines.select(F.col("conv_id").alias("_conv"), "block", _repaired().alias("line")).filter(F.size("line") > 0)
    lines = lines.select("_conv", F.struct("block", F.array_join("line", "\n").alias("text")).alias("p"))
    texts = lines.groupBy("_conv").agg(F.array_join(F.transform(F.sort_array(F.collect_list("p")), lambda x: x["text"]), "\n").alias("text"))
    j = chosen.join(texts.hint("merge"), chosen["conv_id"].eqNullSafe(texts["_conv"]), "left")
    tail = F.when(F.col("best.tail") == "I", F.lit("assistant:")).when(F.col("best.tail") == "II", F.lit("user:\nassistant:"))
    j = j.select(
        F.col("conv_id").alias("_conv"),
        *("gaps", "blank", "duplicate", "truncated", "illegal"),
        F.col("best.cost").alias("cost"),
        F.concat(F.array_join("best.audits", ""), F.col("best.tail")).alias("audit"),
        F.concat_ws("\n", F.col("text"), tail).alias("repaired"),
    )
    every = conversations.select("conv_id").distinct()
    j = every.join(j.hint("merge"), every["conv_id"].eqNullSafe(j["_conv"]), "left").drop("_conv")
    zero = F.lit(0).cast("long")
    return j.select("conv_id", *(F.coalesce(c, zero).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), *(F.coalesce(c, F.lit("")).alias(c) for c in ("audit", "repaired")))


def repair_report(conversations: DataFrame, **how) -> DataFrame:
    """``repair`` with the digest of the repaired conversation in place of its text."""
    return repair(conversations, **how).withColumn("repaired_sha256", F.sha2("repaired", 256)).drop("repaired")
