"""Benchmark decontamination by template windows, in DataFrame functions only.

Texts are canonicalised: numbers (grouped or with decimals: one each), names
(capitalised words inside a sentence) and units become typed placeholders, the
rest is lower-cased words. A capitalised word that opens a sentence may be a
name or not, so windows with one have a second form where it is a name too,
and either form of a document's window may match either of an item's. Windows of
canonical words are hash-joined with those of the benchmark. A document and an
item may align at several offsets; an alignment counts only if its slots are
consistent (each value of the item stands for one value of the document and the
other way round), in itself and with the alignments of more windows that count
already, so re-parameterised questions are caught, with words put in between
too, and chance matches of templates are not. A document is contaminated by an item if consistent
alignments cover at least `share` of the item's windows.

Null and empty texts match nothing. Items of fewer words than a window are one
window of their own length, and match nothing below `least` words; a window
needs `literal` words that are no placeholders. Rows of equal id and text are
one document to the search.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from akshara.llm._frames import NO_ID, checkpointed, field, let

WINDOW, LEAST, SHARE = 8, 5, 0.5
#: Of a window's words, so many at least must be literal.
LITERAL = 0.5
#: Benchmark windows up to which they are broadcast; beyond that the join shuffles.
BROADCAST_WINDOWS = 500_000
#: Bits of the table that tells which windows may be an item's.
BITS = 1 << 17
#: Added to the size of windows that are matched by their own words.
EXACT = 1 << 16
UNITS = ("mm", "cm", "m", "km", "mg", "g", "kg", "ml", "l", "inch", "inches", "foot", "feet", "mile", "miles", "second", "seconds", "minute", "minutes", "hour", "hours", "day", "days", "week", "weeks", "month", "months", "year", "years", "cent", "cents", "dollar", "dollars", "euro", "euros", "percent", "degrees", "meter", "meters", "litre", "litres", "gram", "grams", "pound", "pounds", "ounce", "ounces", "ton", "tons")
#: Private-use characters: before a name, before a capitalised word that opens a sentence, inside a number, and the placeholders.
MARK, OPENS, POINT, NAME, NUMBER, UNIT = "\ue000", "\ue004", "\ue005", "\ue001", "\ue002", "\ue003"
WORDS = "[^\\p{L}\\p{M}\\p{N}" + MARK + OPENS + POINT + "]+"


def marked(text: Column) -> Column:
    """Lower-cased words of a text joined by single spaces, names and words that may be names with a mark, whole numbers as one word without their unit.

    Texts without digits skip the rules of numbers; rules test the sign that is
    rare in a text first.
    """
    bare = F.translate(F.coalesce(text, F.lit("")), MARK + OPENS + POINT + NAME + NUMBER + UNIT, "      ")
    digits = text.rlike(r"\p{Nd}")
    whole = F.regexp_replace(bare, r",(?<=\p{Nd},)(?=\p{Nd}{3}(?!\p{Nd}))", "")
    whole = F.regexp_replace(whole, r"[.,](?<=\p{Nd}[.,])(?=\p{Nd})", POINT)
    named = F.regexp_replace(F.when(digits, whole).otherwise(bare), r"(?=\p{Lu}\p{Ll})(?<=[\p{L}\p{N},;]\s)", MARK)
    named = F.regexp_replace(named, r"(?=\p{Lu}\p{Ll})(?<![\p{L}\p{M}\p{N}" + MARK + r"])", OPENS)
    words = F.btrim(F.lower(F.regexp_replace(named, WORDS, " ")))
    return F.when(digits, F.regexp_replace(words, f"(?<![^ ])(\\p{{Nd}}[\\p{{Nd}}{POINT}]*)({'|'.join(UNITS)})(?![^ ])", "$1 $2")).otherwise(words)


def canonical(text: Column, opens: bool = False) -> Column:
    """marked() text with placeholders for names, numbers, and units after numbers; opens: for words that open a sentence too."""
    out = text if opens else F.replace(text, F.lit(OPENS), F.lit(""))
    out = F.regexp_replace(out, f"[{MARK}{OPENS}][^ ]*", NAME)
    number = F.regexp_replace(out, r"\p{Nd}(?<![^ ].)[^ ]*", NUMBER)
    return F.when(text.rlike(r"\p{Nd}"), F.regexp_replace(number, f"(?<={NUMBER} )(?:{'|'.join(UNITS)})(?![^ ])", UNIT)).otherwise(out)


def values(text: Column) -> Column:
    """The words of marked() text without marks."""
    return split(F.translate(text, MARK + OPENS, ""))


def openings(text: Column) -> Column:
    """Places of the words of marked() text that open a sentence with a capital."""
    at = F.transform(split(text), lambda w, i: F.when(F.startswith(w, F.lit(OPENS)), i + 1))
    return F.filter(at, lambda i: i.isNotNull())


def split(text: Column) -> Column:
    return F.filter(F.split(text, " "), lambda x: x != "")


def opening_hash(words: Column, pos: Column) -> Column:
    """Hash of the first three words of the window at a place (from 1)."""
    return F.xxhash64(F.get(words, pos - 1), F.get(words, pos), F.get(words, pos + 1))


def opening_table(items: DataFrame) -> Column:
    """BITS bits in an array of longs: those of the items' opening hashes. A window without its bit is none of theirs. The table's size is fixed."""
    slot = F.shiftright(F.col("opening").bitwiseAND(F.lit(BITS - 1)), 6)
    rows = items.where("opening is not null").groupBy(slot.alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, cast(opening & 63 as int))")).alias("bits")).collect()
    table = ["0"] * (BITS >> 6)
    for r in rows:
        table[r["at"]] = str(r.bits)
    return F.split(F.lit(",".join(table)), ",").cast("array<bigint>")


def windows(df: DataFrame, keep: list[str], sizes: list[int], table: Column, least: int = LEAST) -> DataFrame:
    """df's keep and every: size, place and hash of the text's windows that may be an item's, in both forms where these differ; df has marked.

    sizes as item_windows() gives them: beyond EXACT for windows of a text's own
    words, below 0 for whole short texts; table: opening_table() of the items.
    """
    none = F.array().cast("array<int>")

    def likely(words: Column, at: Column) -> Column:
        """The places of at whose first three words some window of an item may open with."""
        bit = lambda h: F.getbit(F.get(table, F.shiftright(h.bitwiseAND(F.lit(BITS - 1)), 6).cast("int")), h.bitwiseAND(F.lit(63)).cast("int"))
        hit = lambda hashes: F.filter(F.transform(hashes, lambda h, k: F.when(bit(h) == 1, k)), lambda k: k.isNotNull())
        return let(at, lambda at: F.transform(hit(F.transform(at, lambda i: opening_hash(words, i))), lambda k: F.get(at, k)))

    def of_size(words: Column, code: int, opens: Column | None) -> Column:
        size = code % EXACT
        last = F.size(words) - size + 1
        if opens is None:
            at = F.sequence(F.lit(1), last)
        else:
            at = F.filter(opens, lambda p: p - size + 1 <= last)
            at = F.array_distinct(F.flatten(F.transform(at, lambda p: F.sequence(F.greatest(p - size + 1, F.lit(1)), F.least(p, last)))))
        at = F.when(last >= 1, likely(words, at)).otherwise(none)
        return F.transform(at, lambda i: F.struct(F.lit(code).alias("size"), i.alias("pos"), F.xxhash64(F.slice(words, i, F.lit(size))).alias("hash")))

    def of(x: Column) -> Column:
        parts = [p for size in sizes if 0 < size < EXACT for p in (of_size(x["one"], size, None), of_size(x["two"], size, x["opens"]))]
        parts += [of_size(values(text), size, None) for size in sizes if size > EXACT]
        if min(sizes) < 0:
            whole = F.array(F.struct((-F.size(x["one"])).alias("size"), F.lit(1).alias("pos"), F.xxhash64(values(text)).alias("hash")))
            parts.append(F.filter(whole, lambda y: y["size"] > -least))
        return F.concat(*parts)

    text = F.col("marked")
    both = F.struct(split(canonical(text)).alias("one"), split(canonical(text, True)).alias("two"), openings(text).alias("opens"))
    return df.select(*keep, let(both, of).alias("every"))


def slots(start: Column, size: Column) -> Column:
    """(offset in the window, value) of the placeholders of a window."""
    words, values = F.slice("words", start, size), F.slice("values", start, size)
    pairs = F.transform(F.arrays_zip(words.alias("w"), values.alias("v")), lambda x, i: F.struct(i.alias("at"), x["w"].alias("w"), x["v"].alias("v")))
    return F.transform(F.filter(pairs, lambda x: x["w"].isin(NAME, NUMBER, UNIT)), lambda x: F.struct(x["at"], x["v"]))


def item_windows(benchmark: DataFrame, item_col: str, text_col: str, window: int, least: int) -> DataFrame:
    rows = benchmark.select(field(item_col).cast("long").alias("item_id"), marked(field(text_col)).alias("marked"))
    forms = [F.struct(split(canonical(F.col("marked"), bool(i))).alias("words"), F.lit(i).alias("form")) for i in (0, 1)]
    rows = rows.select("item_id", values(F.col("marked")).alias("values"), openings(F.col("marked")).alias("opens"), F.explode(F.array(*forms)).alias("x"))
    every = rows.select("item_id", "values", "opens", "x.words", "x.form").where(F.size("words") > 0)
    rows = every.where(F.size("words") >= least).withColumn("size", F.least(F.size("words"), F.lit(window)))
    rows = rows.select("item_id", "words", "values", "size", "opens", "form", F.explode(F.sequence(F.lit(1), F.size("words") - F.col("size") + 1)).alias("item_pos"))
    # a window that no word opens is the same in both forms
    opened = F.exists("opens", lambda p: (p >= F.col("item_pos")) & (p < F.col("item_pos") + F.col("size")))
    rows = rows.withColumn("forms", F.when(opened, F.array("form")).otherwise(F.array(F.lit(0), F.lit(1)))).where(opened | (F.col("form") == 0))
    rows = rows.select("item_id", "size", "item_pos", "forms", F.xxhash64(F.slice("words", F.col("item_pos"), F.col("size"))).alias("hash"), slots(F.col("item_pos"), F.col("size")).alias("item_slots"), F.slice("values", F.col("item_pos"), F.col("size")).alias("own"), opening_hash(F.col("words"), F.col("item_pos")).alias("opening"))
    rows = rows.withColumn("enough", F.size("item_slots") <= F.col("size") * (1 - LITERAL)).withColumn("some", F.max("enough").over(Window.partitionBy("item_id")))
    none = F.lit(None).cast(rows.schema["item_slots"].dataType)
    exact = lambda size, words: [size.alias("size"), F.col("item_pos"), F.array(F.lit(0)).alias("forms"), F.xxhash64(words).alias("hash"), F.coalesce(none, F.filter(F.array(F.struct(F.lit(0).alias("at"), F.lit("").alias("v"))), lambda x: F.lit(False))).alias("item_slots")]
    rare = rows.where(~F.col("some")).select("item_id", *exact(F.col("size") + EXACT, F.col("own")), opening_hash(F.col("own"), F.lit(1)).alias("opening")).dropDuplicates(["item_id", "item_pos"])
    short = every.where((F.size("words") < least) & (F.col("form") == 0)).withColumn("item_pos", F.lit(1)).select("item_id", *exact(-F.size("words"), F.col("values")), F.lit(None).cast("bigint").alias("opening"))
    usual = rows.where("enough").select("item_id", "size", "item_pos", "forms", "hash", "item_slots", "opening")
    return usual.unionByName(rare).unionByName(short)


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, share: float = SHARE, least: int = LEAST) -> DataFrame:
    """One row per contaminated document and item: doc_id, key (a hash of id and text), item_id, n_windows, item_windows, share, changed_slots."""
    items = item_windows(benchmark, item_col, item_text_col, window, least)
    facts = items.agg(F.count("*").alias("n"), F.collect_set("size").alias("sizes")).first()
    table = opening_table(items)
    items = items.drop("opening")
    total = items.groupBy("item_id").agg(F.countDistinct("item_pos").alias("item_windows"))
    if facts.n <= BROADCAST_WINDOWS:
        items, total = F.broadcast(items), F.broadcast(total)
    rows = docs.select(field(id_col).cast("long").alias("doc_id"), F.xxhash64(field(id_col), field(text_col)).alias("key"), field(text_col).alias("text"))
    found = windows(rows.select("doc_id", "key", marked(F.col("text")).alias("marked")), ["doc_id", "key"], sorted(facts.sizes) or [window], table, least)
    # hashes alone are exploded; the words of a matched window are cut out by its place afterwards
    hits = found.select("doc_id", "key", F.explode_outer("every").alias("w")).select("doc_id", "key", "w.size", "w.pos", "w.hash")
    hits = checkpointed(hits.join(items, ["size", "hash"]).select("doc_id", "key", "item_id", "size", "pos", "item_pos", "forms", "item_slots"))
    plain = hits.where(F.size("item_slots") == 0).select("doc_id", "key", "item_id", "item_pos", F.lit(0).alias("changed"))
    slotted = hits.where(F.size("item_slots") > 0)
    if not slotted.isEmpty():
        plain = plain.unionByName(consistent(slotted, rows))
    both = plain.groupBy("doc_id", "key", "item_id").agg(F.size(F.collect_set("item_pos")).alias("n_windows"), F.max("changed").alias("changed_slots"))
    both = both.join(total, "item_id").withColumn("share", F.col("n_windows") / F.col("item_windows"))
    return both.where(F.col("share") >= share).select("doc_id", "key", "item_id", F.col("n_windows").cast("long"), "item_windows", "share", F.col("changed_slots").cast("long"))


def consistent(slotted: DataFrame, rows: DataFrame) -> DataFrame:
    """Of matched windows with slots, those of alignments whose slots stand for each other one to one, within an alignment and across those taken.

    The alignment with most windows is taken first, each other one only if its
    pairs agree with all that are taken; what is held for a document and an item
    is bounded by the document's own matches.
    """
    which = slotted.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("d"), F.col("key").alias("k")).distinct()
    own = rows.withColumns({"d": F.coalesce("doc_id", F.lit(NO_ID)), "k": F.col("key")}).join(which, ["d", "k"], "left_semi").dropDuplicates(["d", "k"])
    own = own.select("d", "k", values(marked(F.col("text"))).alias("values"))
    slotted = slotted.join(own, (F.coalesce("doc_id", F.lit(NO_ID)) == F.col("d")) & (F.col("key") == F.col("k")))
    pairs = F.transform("item_slots", lambda x: F.named_struct(F.lit("item"), x["v"], F.lit("doc"), F.get("values", F.col("pos") + x["at"] - 1)))
    slotted = slotted.select("doc_id", "key", "item_id", "item_pos", (F.col("pos") - F.col("item_pos")).alias("offset"), F.explode("forms").alias("form"), pairs.alias("pairs"))
    aligned = slotted.groupBy("doc_id", "key", "item_id", "offset", "form").agg(F.collect_set("item_pos").alias("places"), F.array_distinct(F.flatten(F.collect_set("pairs"))).alias("pairs"))

    # alignments alike (a passage that comes many times) are one
    way = F.struct((-F.size("places")).alias("less"), F.array_sort("places").alias("places"), F.array_sort("pairs").alias("pairs"))
    ways = aligned.where(one_to_one(F.col("pairs"))).groupBy("doc_id", "key", "item_id").agg(F.array_sort(F.collect_set(way)).alias("ways"))

    def joined(taken: Column, more: Column) -> Column:
        pairs = F.array_union(taken["pairs"], more["pairs"])
        both = F.struct(F.array_union(taken["places"], more["places"]).alias("places"), pairs.alias("pairs"))
        return F.when(one_to_one(pairs), both).otherwise(taken)

    none = F.struct(F.slice(F.col("ways")[0]["places"], 1, 0).alias("places"), F.slice(F.col("ways")[0]["pairs"], 1, 0).alias("pairs"))
    agreed = ways.select("doc_id", "key", "item_id", F.aggregate("ways", none, joined).alias("x"))
    return agreed.select("doc_id", "key", "item_id", F.explode("x.places").alias("item_pos"), F.size(F.filter("x.pairs", lambda p: p["item"] != p["doc"])).alias("changed"))


def one_to_one(pairs: Column) -> Column:
    """Whether no value of either side stands in two of distinct pairs."""
    own, theirs = F.transform(pairs, lambda p: p["item"]), F.transform(pairs, lambda p: p["doc"])
    return (F.size(F.array_distinct(own)) == F.size(pairs)) & (F.size(F.array_distinct(theirs)) == F.size(pairs))


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs without those that a benchmark item contaminates, with their columns as they were."""
    bad = contaminated(docs, benchmark, id_col, text_col, **options).select(F.coalesce("doc_id", F.lit(NO_ID)).alias("__d"), F.col("key").alias("__k")).distinct()
    mine = (F.coalesce(field(id_col).cast("long"), F.lit(NO_ID)) == bad["__d"]) & (F.xxhash64(field(id_col), field(text_col)) == bad["__k"])
    return docs.join(bad, mine, "left_anti")
