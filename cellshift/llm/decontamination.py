"""Operator 3: benchmark decontamination by canonical templates, in DataFrame functions alone.

Every word is read twice: plainly, as lower case, and as a template, where numbers, units behind numbers and names
(words written with a capital, but not with capitals only) turn into typed placeholders. Windows of WIDTH words are hashed in both
readings on both sides and hash-joined; a window of placeholders alone tells nothing and counts only for items that hold no
other. A question asked again with other numbers or names has the same template windows, wherever its names stand; a
verbatim copy in other letter case has the same plain ones. That the slots tell one story is checked on the values: one item value
must always meet one document value and the other way round. It is checked inside each alignment (windows of an item at
one distance from their places in the document) that covers at least `coverage` of the item's windows by itself, and over
all windows of the document together, so that a copy with words put in is found too. A pair is a leak if any of
these passes. Items of fewer words than WIDTH are one window, which is looked for at every place.

A pair that covers an item must meet one of its rarest windows: of w windows, of which c are needed, the w - c + 1 that fewest
documents hold. Only these make candidates; the other windows are looked up for the candidates alone, so a window that many
documents and many items share is no all-pairs join.

The item side is broadcast only while it has at most BROADCAST_WINDOWS windows, counted first; beyond that
both sides are shuffled on the hash. Raw words are looked up again only in documents whose windows hold slots.

Defined cases: null and empty texts match nothing; items without words match nothing; equal items are reported each;
repeated documents with one doc_id count once per different text; empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellshift.llm.common import let, materialize

WIDTH, COVERAGE, BROADCAST_WINDOWS = 5, 0.5, 500_000
# Units that become a placeholder behind a number.
UNITS = "mm cm m km in ft mi mg g kg t lb oz ml l s ms min h hr hour hours minute minutes second seconds day days week weeks month months year years eur usd dollar dollars euro euros cent cents percent kmh mph w kw v a hz".split()
# A word or a number. Repeated groups are possessive: Java would recurse on others, once per repeat.
TOKEN = r"\p{L}++|\d++(?:[.,]\d++)*+"
NUMBER, UNIT, NAME = -1, -2, -3  # placeholders, beside word hashes


def raw_words(text: str = "text") -> Column:
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))


def _is_number(w: Column) -> Column:
    return (w >= "0") & (w < ":")


def plain(words: Column) -> Column:
    """Hashes of lower-cased words."""
    return F.transform(words, lambda w: F.xxhash64(F.lower(w)))


def canonical(words: Column, hashes: Column) -> Column:
    """Placeholders, else the words' hashes."""

    def one(w: Column, i: Column) -> Column:
        first, low = F.substring(w, 1, 1), F.lower(w)
        name = (F.lower(first) != first) & (F.upper(w) != w)
        unit = low.isin(*UNITS) & _is_number(F.get(words, i - 1))
        return F.when(_is_number(w), NUMBER).when(name, NAME).when(unit, UNIT).otherwise(F.get(hashes, i)).cast("long")

    return F.transform(words, one)


def _read(words: Column, body) -> Column:
    """body(plain, canonical codes) of words, each computed once."""
    return let(words, lambda raw: let(plain(raw), lambda p: let(canonical(raw, p), lambda c: body(p, c))))


def _window(codes: Column, place: Column, width: int | Column) -> Column:
    return F.xxhash64(F.slice(codes, place + 1, width))


def document_windows(words: Column, widths: list[int]) -> Column:
    """Hashes of the windows of all widths at every place, plain and canonical, 2 * len(widths) of a place in a row; shorter at the end."""

    def runs(p: Column, c: Column) -> Column:
        each = F.transform(F.sequence(F.lit(0), F.greatest(F.size(p) - 1, F.lit(0))), lambda i: F.array(*[_window(codes, i, w) for w in widths for codes in (p, c)]))
        return F.when(F.size(p) > 0, F.flatten(each)).otherwise(F.array().cast("array<bigint>"))

    return _read(words, runs)


def item_index(items: DataFrame, width: int) -> DataFrame:
    """(item_id, windows, length, place, run, item_slots): plain and template windows that count, item_slots (at, value) of templates."""
    rows = items.select("item_id", "text").where(F.col("text").isNotNull()).withColumn("__raw", raw_words()).where(F.size("__raw") > 0)
    rows = materialize(rows.select("item_id", "__raw", _read(F.col("__raw"), lambda p, c: F.struct(p.alias("p"), c.alias("c"))).alias("__codes")), "items")
    length = F.least(F.size("__raw"), F.lit(width))
    places = rows.select("*", length.alias("length"), F.explode(F.sequence(F.lit(0), F.size("__raw") - length)).alias("place"))
    held = F.slice("__codes.c", F.col("place") + 1, F.col("length"))
    slots = F.filter(F.sequence(F.lit(0), F.col("length") - 1), lambda j: F.get(held, j).isin(NUMBER, UNIT, NAME))
    places = places.withColumn("__slots", slots).withColumn("__bare", F.size("__slots") == F.col("length"))
    whole = Window.partitionBy("item_id", "__raw")
    places = places.withColumn("__usual", F.count_if(~F.col("__bare")).over(whole)).where(~F.col("__bare") | (F.col("__usual") == 0))
    places = places.withColumn("windows", F.count("*").over(whole))
    values = F.transform("__slots", lambda j: F.struct(j.alias("at"), F.lower(F.get("__raw", F.col("place") + j)).alias("value")))
    none = F.array().cast("array<struct<at:int,value:string>>")
    plain_run = F.struct(_window(F.col("__codes.p"), F.col("place"), F.col("length")).alias("run"), none.alias("item_slots"))
    template = F.struct(_window(F.col("__codes.c"), F.col("place"), F.col("length")).alias("run"), values.alias("item_slots"))
    runs = F.when((F.size("__slots") > 0) & ~F.col("__bare"), F.array(plain_run, template)).otherwise(F.array(plain_run))
    return materialize(places.select("item_id", "windows", "length", "place", F.explode(runs).alias("x")).select("item_id", "windows", "length", "place", "x.run", "x.item_slots"), "item-windows")


def leaks(docs: DataFrame, items: DataFrame, width: int = WIDTH, coverage: float = COVERAGE) -> DataFrame:
    """(doc_id, item_id, matched, windows, coverage, slots, kind): kind is `same` where every slot has the item's
    value, else `reparameterised`. matched counts the item's windows found in the document."""
    index = item_index(items, width)
    widths = sorted({width} | {r["length"] for r in index.select("length").distinct().collect()}, reverse=True)  # width values at most
    runs = index.select(F.col("run").alias("known")).distinct()
    small = runs.count() <= BROADCAST_WINDOWS
    keyed = docs.select("doc_id", "text").where(F.col("text").isNotNull()).withColumn("same", F.xxhash64("text"))
    exploded = keyed.select("doc_id", "same", F.posexplode_outer(document_windows(raw_words(), widths)).alias("nth", "run"))  # outer: no filter below repeats the hashing
    hits = exploded.join(F.broadcast(runs) if small else runs, F.col("run") == F.col("known"), "left_semi")
    hits = materialize(hits.select("doc_id", "same", F.floor(F.col("nth") / (2 * len(widths))).cast("int").alias("doc_place"), "run"), "window-hits")
    holds = materialize(hits.select("doc_id", "same", "run").distinct(), "document-windows")
    # candidates meet one of an item's rarest windows; coverage comes next: few pairs pass it, and only their places are looked at further
    rarity = holds.groupBy("run").agg(F.count("*").alias("n_docs"))
    asked = index.join(rarity, "run", "left").groupBy("item_id", "windows", "place").agg(F.sum("n_docs").alias("n_docs"), F.collect_set("run").alias("runs"))
    nth = F.row_number().over(Window.partitionBy("item_id").orderBy(F.col("n_docs").asc_nulls_first(), "place"))
    rarest = asked.withColumn("nth", nth).where(F.col("nth") <= F.col("windows") - F.ceil(coverage * F.col("windows") - 1e-9) + 1)
    rarest = materialize(rarest.where("n_docs is not null").select(F.col("item_id").alias("i"), F.explode("runs").alias("run")), "rarest")
    pairs = holds.join(rarest, "run").select(F.col("doc_id").alias("d"), F.col("same").alias("s"), "i").distinct()
    here = F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("same") == F.col("s"))
    asking = pairs.join(index.select("item_id", "windows", "place", F.col("run").alias("r")), F.col("i").eqNullSafe(F.col("item_id")))
    met = asking.join(holds, here & (F.col("run") == F.col("r")))
    passed = materialize(met.groupBy("doc_id", "same", "item_id").agg(F.count_distinct("place").alias("matched"), F.max("windows").alias("windows"))
                         .where(F.col("matched") >= coverage * F.col("windows")), "covered")
    slotted = index.where(F.size("item_slots") > 0)
    wanted = passed.join(slotted.select("item_id").distinct(), "item_id", "left_semi").select(F.col("doc_id").alias("d"), F.col("same").alias("s"), "item_id")
    asked_docs = materialize(wanted.select("d", "s").distinct(), "slot-documents")  # its size is known: while it is small no text is shuffled
    looked = keyed.join(asked_docs, here).select("doc_id", "same", raw_words().alias("__raw"))
    slot_hits = hits.join(slotted.select("run").distinct(), "run", "left_semi").join(asked_docs, here, "left_semi")
    at = slot_hits.groupBy(F.col("doc_id").alias("d"), F.col("same").alias("s")).agg(F.collect_set(F.struct("doc_place", "run")).alias("places"))
    looked = looked.join(at, here)  # words of these documents alone
    cut = looked.select("doc_id", "same", F.explode(F.transform("places", lambda p: F.struct(p.doc_place.alias("doc_place"), p.run.alias("run"), F.slice("__raw", p.doc_place + 1, width).alias("raw")))).alias("x")).select("doc_id", "same", "x.*")
    shift = (F.col("doc_place") - F.col("place")).alias("shift")
    chosen = passed.select(F.col("doc_id").alias("d"), F.col("same").alias("s"), F.col("item_id").alias("i"), "matched", F.col("windows").alias("of"))
    valued = cut.join(slotted, "run").join(chosen, here & F.col("item_id").eqNullSafe(F.col("i")), "left_semi")
    valued = valued.select("doc_id", "same", "item_id", shift, F.explode("item_slots").alias("slot"), "raw")
    values = materialize(valued.select("doc_id", "same", "item_id", "shift", F.col("slot.value").alias("theirs"), F.lower(F.get("raw", F.col("slot.at"))).alias("ours")).distinct(), "slot-values")
    found = chosen.join(index.select("item_id", "place", F.col("run").alias("r")), F.col("i").eqNullSafe(F.col("item_id"))).join(hits, here & (F.col("run") == F.col("r")))
    aligned = found.groupBy("doc_id", "same", "item_id", shift).agg(F.count_distinct("place").alias("inside"), F.max("matched").alias("matched"), F.max("of").alias("windows"))
    aligned = aligned.where(F.col("inside") >= coverage * F.col("windows")).drop("inside")
    judged = consistent(aligned, values, ["doc_id", "same", "item_id", "shift"]).drop("shift")
    judged = judged.unionByName(consistent(passed, values.drop("shift").distinct(), ["doc_id", "same", "item_id"]))
    return judged.groupBy("doc_id", "item_id").agg(
        F.max("matched").alias("matched"), F.max("windows").alias("windows"), F.max(F.col("matched") / F.col("windows")).alias("coverage"),
        F.max("slots").alias("slots"), F.when(F.max("equal") == 1, "same").otherwise("reparameterised").alias("kind"),
    )


def consistent(pairs: DataFrame, values: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of pairs (by keys) whose slot values (theirs, ours) map one to one, with the number of slots and whether all are equal (1)."""
    one = values.groupBy(*keys, "theirs").agg(F.count("*").alias("n")).groupBy(*keys).agg(F.max("n").alias("forward"), F.count("*").alias("slots"))
    other = values.groupBy(*keys, "ours").agg(F.count("*").alias("n"), F.min((F.col("ours") == F.col("theirs")).cast("int")).alias("equal")).groupBy(*keys).agg(F.max("n").alias("backward"), F.min("equal").alias("equal"))
    named = [one.withColumnsRenamed({k: f"__{k}" for k in keys}), other.withColumnsRenamed({k: f"_{k}" for k in keys})]
    met, match = F.lit(True), F.lit(True)
    for k in keys:
        met &= F.col(f"__{k}").eqNullSafe(F.col(f"_{k}"))
        match &= F.col(k).eqNullSafe(F.col(f"__{k}"))
    told = named[0].join(named[1], met).drop(*[f"_{k}" for k in keys])
    judged = pairs.join(told, match, "left").where((F.coalesce("forward", F.lit(1)) == 1) & (F.coalesce("backward", F.lit(1)) == 1))
    return judged.select(*pairs.columns, F.coalesce("slots", F.lit(0)).alias("slots"), F.coalesce("equal", F.lit(1)).alias("equal"))
