"""Lists of terms as a table: every token, stem and pair of neighbouring words of a text is looked up once, whatever the length of the list.

A single word is found as a token or by an equal stem, a phrase as a substring
of the normalised lower-case text, as text.term_hits() has it. A phrase is looked
up by what stands around its first blank (up to REACH characters on either side)
and then compared as a whole, so only the texts of likely phrases are fetched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from akshara.functions import text as X
from akshara.operators import articles as A

#: Characters around a phrase's first blank that it is looked up by, at most.
REACH = 3
#: Keys of a lexicon that is broadcast, at most.
SMALL = 200_000


def around(left: Column, right: Column, a: int, b: int) -> Column:
    """The kind and key of a blank between two words."""
    return F.struct(F.lit(f"p{a}{b}").alias("kind"), F.concat(F.right(left, F.lit(a)), F.lit(" "), F.left(right, F.lit(b))).alias("key"))


def lexicon_keys(lexicon: DataFrame, name: str = "list", term: str = "term") -> DataFrame:
    """kind, key, list and term of every term; empty ones have none. Words have a token's and a stem's key, phrases one for the sizes that their first words have."""
    rows = lexicon.select(F.col(name).alias("list"), F.lower(X.normalized(F.col(term))).alias("term")).where("term <> ''").distinct()
    parts = F.split("term", " ")
    left, right = F.get(parts, F.lit(0)), F.get(parts, F.lit(1))
    sizes = [(a, b) for a in range(1, REACH + 1) for b in range(1, REACH + 1)]
    phrase = F.coalesce(*[F.when((F.least(F.length(left), F.lit(REACH)) == a) & (F.least(F.length(right), F.lit(REACH)) == b), around(left, right, a, b)) for a, b in sizes])
    word = lambda kind, key: F.struct(F.lit(kind).alias("kind"), key.alias("key"))
    keys = F.when(F.size(parts) > 1, F.array(phrase)).otherwise(F.array(word("word", F.col("term")), word("stem", X.light_stem(F.col("term")))))
    return rows.select("list", "term", F.explode(keys).alias("k")).select("k.kind", "k.key", "list", "term")


def text_keys(words: Column, stems: Column, blob: Column, kinds: list[str]) -> Column:
    """The distinct kinds and keys under which terms may stand that a text holds."""
    named = lambda kind, keys: F.transform(keys, lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("key")))
    out = [named(kind, keys) for kind, keys in (("word", words), ("stem", stems)) if kind in kinds]
    sizes = [(int(k[1]), int(k[2])) for k in kinds if k[0] == "p"]
    if sizes:
        parts = F.split(blob, " ")
        pairs = F.arrays_zip(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0))).alias("a"), F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))).alias("b"))
        at = lambda a, b: lambda x: around(x["a"], x["b"], a, b)["key"]
        out += [named(f"p{a}{b}", F.array_distinct(F.transform(pairs, at(a, b)))) for a, b in sizes]
    return F.concat(*out) if out else F.array().cast("array<struct<kind:string,key:string>>")


def lexicon_hits(df: DataFrame, idx: str, text: Column, lexicon: DataFrame, name: str = "list", term: str = "term") -> DataFrame:
    """idx (unique), list and term, distinct: the terms of a lexicon that each text holds.

    The lexicon is joined as a table: it is broadcast up to SMALL keys, so that
    what a text does not hold is dropped before anything travels; a larger one
    and the keys of the texts are both dealt out by key. Texts are joined once
    more where phrases are likely.
    """
    # a text that holds a word as a token holds its stem too, so a word's own key would find nothing more
    keys = A.checkpointed(lexicon_keys(lexicon, name, term).where("kind <> 'word'"))
    sizes = {r.kind: r["count"] for r in keys.groupBy("kind").count().collect()}  # at most REACH^2 + 1
    rows = A.with_tokens(A.dealt(df.select(F.col(idx).alias("idx"), text.alias("text")), "idx"), F.col("text"))
    found = rows.select("idx", F.explode(text_keys(F.col("words"), F.col("stems"), F.col("blob"), sorted(sizes))).alias("k")).select("idx", "k.kind", "k.key")
    found = found.join(F.broadcast(keys) if sum(sizes.values()) <= SMALL else keys, ["kind", "key"]).select("idx", "list", "term").distinct()
    found = A.checkpointed(found.withColumn("phrase", F.contains("term", F.lit(" "))))
    likely = found.where("phrase").groupBy("idx").agg(F.collect_set(F.struct("list", "term")).alias("t"))
    whole = rows.select("idx", "blob").join(likely, "idx").select("idx", F.inline(F.filter("t", lambda x: F.contains(F.col("blob"), x["term"]))))
    return found.where(~F.col("phrase")).select("idx", "list", "term").unionByName(whole.select("idx", "list", "term"))
