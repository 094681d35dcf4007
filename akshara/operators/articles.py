"""Article operators: first-wins dedup, scoring, gates, clusters and merging."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from akshara.functions import lexicon as L
from akshara.functions import text as X


def first_wins(df: DataFrame, key: str, order: list[str], keep_empty: bool = True) -> DataFrame:
    """The first row of each key; rows with an empty key are never dropped when keep_empty."""
    at = Window.partitionBy(key).orderBy(*order)
    if not keep_empty:
        return df.withColumn("__n", F.row_number().over(at)).where("__n = 1").drop("__n")
    full = df.where(F.col(key) != "").withColumn("__n", F.row_number().over(at)).where("__n = 1").drop("__n")
    return full.unionByName(df.where(F.coalesce(F.col(key), F.lit("")) == ""))


def capped(df: DataFrame, by: str, order: list[str], n: int) -> DataFrame:
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("__n") <= n).drop("__n")


def coverage(df: DataFrame, source: str, story: str) -> DataFrame:
    """df with the figures that a story carries of its source's; null scores where either has none."""
    out = df.withColumns({"__a": X.numbers(F.col(source)), "__b": X.numbers(F.col(story))})
    out = out.withColumn("__n", F.size(F.array_intersect("__a", "__b"))).withColumn("__ok", (F.size("__a") > 0) & (F.size("__b") > 0))
    none = F.array().cast("array<string>")
    score = F.when(F.col("__ok"), X.percent(F.col("__n"), F.size("__a")))
    level = F.when(score >= 60, "Comprehensive").when(score >= 30, "Selective").otherwise("Sparse")
    detail = F.when(F.col("__ok"), F.format_string("%s: story carries %d of %d source figures.", level, F.col("__n"), F.size("__a"))).otherwise("Insufficient numeric content for comparison.")
    return out.withColumns(
        {
            "coverage_score": score,
            "number_precision": F.when(F.col("__ok"), X.percent(F.col("__n"), F.size("__b"))),
            "source_numbers": F.size("__a"),
            "story_numbers": F.size("__b"),
            "numbers_carried": F.when(F.col("__ok"), F.col("__n")).otherwise(0),
            "numbers_unsupported": F.when(F.col("__ok"), X.by_value(F.array_except("__b", "__a"))).otherwise(none),
            "numbers_missed": F.when(F.col("__ok"), X.by_value(F.array_except("__a", "__b"))).otherwise(none),
            "coverage_detail": detail,
        }
    ).drop("__a", "__b", "__n", "__ok")


def with_tokens(df: DataFrame, text: Column, least_hi: int = 2, least_en: int = 3) -> DataFrame:
    """df with blob, words and stems of a text, each computed once."""
    out = df.withColumn("blob", F.lower(X.normalized(text)))
    out = out.withColumn("words", X.tokens(F.col("blob"), least_hi, least_en, lowered=True))
    # Latin words are their own stems
    return out.withColumn("stems", F.when(X.has_devanagari(F.col("blob")), F.array_distinct(F.transform("words", X.light_stem))).otherwise(F.col("words")))


def relevant(blob: str = "blob", strong=L.STRONG, weak=L.WEAK) -> Column:
    """One strong term or two weak ones; needs the columns of with_tokens()."""
    hits = lambda terms: F.size(X.term_hits(terms, F.col(blob), F.col("words"), F.col("stems")))
    return (hits(strong) > 0) | (hits(weak) >= 2)


def impact(df: DataFrame, level: Column) -> DataFrame:
    """df of with_tokens() with the level that the source's words give, its first five terms, and whether the label agrees."""
    hits = lambda terms: X.term_hits(terms, F.col("blob"), F.col("words"), F.col("stems"))
    out = df.withColumns({"__h": hits(L.IMPACT_HIGH), "__m": hits(L.IMPACT_MEDIUM)})
    rule = F.when(F.size("__h") > 0, "High").when(F.size("__m") > 0, "Medium").otherwise("Low")
    found = F.when(F.size("__h") > 0, F.col("__h")).otherwise(F.col("__m"))
    return out.withColumns({"impact_rule_level": rule, "impact_evidence": F.slice(found, 1, 5), "impact_agrees": rule == level}).drop("__h", "__m")


def gates(df: DataFrame, title: str, body: str, story: str, off_topic: Column) -> DataFrame:
    """df of coverage() with gates_passed, grounding_ceiling and gate_failures; off_topic: whether the source is outside the subject."""
    degenerate = F.coalesce(F.length(story) < 30, F.lit(True)) | F.col(story).startswith("Generation failed") | F.col(story).startswith("[Not generated")
    short = F.length(F.coalesce(F.col(body), F.lit(""))) < 300
    n = F.size("numbers_unsupported")
    imprecise = F.coalesce(F.col("number_precision") < 90, F.lit(False))
    ceiling = F.least(F.lit(100), F.when(off_topic | degenerate, 0), F.when(short, 20), F.when(imprecise, F.greatest(F.lit(0), 100 - 15 * n)))
    failures = F.array(F.when(off_topic, "off-topic source (no railway content)"), F.when(short, "source body under 300 chars"), F.when(degenerate, "degenerate story"), F.when(imprecise, F.format_string("%d%% numeric precision — %d unsupported figure(s)", F.col("number_precision"), n)))
    failures = F.filter(failures, lambda x: x.isNotNull())
    return df.withColumns({"grounding_ceiling": ceiling, "gate_failures": failures, "gates_passed": F.size(failures) == 0})


def title_classes(df: DataFrame, idx: str, words: str) -> tuple[DataFrame, DataFrame]:
    """Members (i, cls) and classes (cls, w, size) of equal word sets; cls is the smallest idx. Rows without words are in none."""
    rows = df.select(F.col(idx).alias("i"), F.array_sort(words).alias("w")).where(F.size("w") > 0)
    classes = rows.groupBy("w").agg(F.min("i").alias("cls"), F.count("*").alias("size"))
    return rows.join(classes, "w").select("i", "cls"), classes


def ranked_sets(classes: DataFrame, threshold: float) -> DataFrame:
    """cls, n (words), o (those that other classes have too, the rare ones first) and need (words that any partner shares) of classes that can have a partner."""
    rows = classes.select("cls", F.size("w").alias("n"), F.explode("w").alias("t"))
    often = rows.groupBy("t").agg(F.count("*").alias("f")).where("f > 1")
    ranked = rows.join(often, "t").groupBy("cls").agg(F.first("n").alias("n"), F.array_sort(F.collect_list(F.struct("f", F.xxhash64("t").alias("x"), F.xxhash64(F.lit("second"), "t").alias("y")))).alias("o"))
    return checkpointed(ranked.withColumn("need", F.ceil(F.col("n") * F.lit(threshold) - 1e-9).cast("int")).where(F.size("o") >= F.col("need")))


def linked(k: int, n: Column, m: Column, threshold: float) -> Column:
    """Whether k common words link sets of n and m words."""
    return F.lit(k) >= F.lit(threshold) * (n + m - k)


def shared_subsets(sets: DataFrame, threshold: float) -> Iterator[tuple[int, DataFrame]]:
    """k and the subsets of k words that several classes hold: x, y (128 bits of the subset), cls, n, need, hub (n and cls of the fewest words among them) and most (words).

    Subsets grow by a word a round, the rare words first; those that one class
    alone has end, and so do classes in them that k words link with their largest.
    """
    alive, k = sets.select("cls", F.lit(0).alias("at"), F.lit(0).cast("long").alias("x"), F.lit(0).cast("long").alias("y")), 0
    while not alive.isEmpty():
        k += 1
        last = F.size("o") - F.greatest(F.col("need") - k, F.lit(0))
        more = F.transform(F.slice("o", F.col("at") + 1, F.greatest(last - F.col("at"), F.lit(0))), lambda v, i: F.struct((F.col("at") + i + 1).alias("at"), F.xxhash64("x", v["x"]).alias("x"), F.xxhash64("y", v["y"]).alias("y")))
        grown = alive.join(sets, "cls").select("cls", "n", "need", F.explode(more).alias("v")).select("cls", "n", "need", "v.at", "v.x", "v.y")
        groups = grown.groupBy("x", "y").agg(F.count("*").alias("c"), F.min(F.struct("n", "cls")).alias("hub"), F.max("n").alias("most")).where("c > 1").drop("c")
        held = checkpointed(grown.join(groups, ["x", "y"]))
        yield k, held
        alive = held.where(~linked(k, F.col("n"), F.col("most"), threshold)).select("cls", "at", "x", "y")


#: Common words by which pairs of titles are found, at most.
DEPTH = 4


def story_edges(classes: DataFrame, threshold: float) -> DataFrame:
    """a < b and score: pairs of classes whose word sets have a Jaccard similarity of threshold or more.

    Pairs meet in a subset of as many words as must be common, up to DEPTH; so a
    frequent word forms pairs only where it links. Ids alone meet there; each
    pair then fetches its whole sets once.
    """
    found = []
    for k, held in shared_subsets(ranked_sets(classes, threshold), threshold):
        n, m = F.col("n"), F.col("m")
        if k < DEPTH:
            held = held.where(linked(k, n, F.greatest(F.lit(k), F.col("need")), threshold))
        first = held.select("x", "y", F.col("cls").alias("a"), "n")
        other = held.select("x", "y", F.col("cls").alias("b"), F.col("n").alias("m"))
        alike = (F.least(n, m) >= F.lit(threshold) * F.greatest(n, m) - 1e-9) & ~linked(k - 1, n, m, threshold)
        alike = alike & linked(k, n, m, threshold) if k < DEPTH else alike
        found.append(first.join(other, ["x", "y"]).where((F.col("a") < F.col("b")) & alike).select("a", "b"))
        if k == DEPTH:
            break
    if not found:
        return classes.select(F.col("cls").alias("a"), F.col("cls").alias("b"), F.lit(1.0).alias("score")).limit(0)
    pairs = reduce(DataFrame.unionByName, found).distinct()
    of = lambda c, w: classes.select(F.col("cls").alias(c), F.col("w").alias(w))
    k = F.size(F.array_intersect("w", "v"))
    union = F.size("w") + F.size("v") - k
    return pairs.join(of("a", "w"), "a").join(of("b", "v"), "b").where(k >= F.lit(threshold) * union).select("a", "b", (k / union).alias("score"))


def story_links(classes: DataFrame, threshold: float) -> DataFrame:
    """a and b: links of classes that leave the components as all of story_edges() do, some per class and not some per pair.

    Two sets of n and m words link when they share k or more, k the least with
    k >= threshold (n + m - k). So classes that share k words are linked with the
    one of fewest words among them, and who links with any of them through these
    words links with that one.
    """
    links = [classes.select(F.col("cls").alias("a"), F.col("cls").alias("b")).limit(0)]
    for k, held in shared_subsets(ranked_sets(classes, threshold), threshold):
        near = (F.col("cls") != F.col("hub.cls")) & linked(k, F.col("n"), F.col("hub.n"), threshold)
        links.append(held.where(near).select(F.col("hub.cls").alias("a"), F.col("cls").alias("b")))
    return reduce(DataFrame.unionByName, links).distinct()


def story_components(df: DataFrame, idx: str, words: str, threshold: float) -> DataFrame:
    """node and cluster of every row: single linkage of its word set. Equal sets are one class from the start, so a title that a million rows have costs no pair."""
    members, classes = title_classes(df, idx, words)
    classes = checkpointed(classes)
    found = components(classes.select("cls"), story_links(classes, threshold))
    rows = members.join(found, F.col("cls") == F.col("node")).select("i", "cluster")
    return df.select(F.col(idx).alias("node")).join(rows, F.col("node") == F.col("i"), "left").select("node", F.coalesce("cluster", "node").alias("cluster"))


def same_story(df: DataFrame, idx: str, words: str, threshold: float = 0.45, most: int = 10) -> DataFrame:
    """For each row the rows of nearly its title, the likest first and equal ones by idx: i, others (how many there are), place (from 0, below most), other and score.

    Counts come from the classes' sizes. Of a class only the first most + 1
    members can stand in a list, so only those are joined to its neighbours.
    """
    members, classes = title_classes(df, idx, words)
    members, classes = checkpointed(members), checkpointed(classes)
    edges = story_edges(classes, threshold)
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "score")).unionByName(classes.select(F.col("cls").alias("a"), F.col("cls").alias("b"), F.lit(1.0).alias("score")))
    both = checkpointed(both)
    sizes = classes.select(F.col("cls").alias("b"), "size")
    others = both.join(sizes, "b").groupBy("a").agg((F.sum("size") - 1).alias("others"))
    few = members.withColumn("__n", F.row_number().over(Window.partitionBy("cls").orderBy("i"))).where(F.col("__n") <= most + 1).select(F.col("cls").alias("b"), F.col("i").alias("other"))
    place = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("score"), "other"))
    lists = both.join(few, "b").withColumn("__p", place).where(F.col("__p") <= most + 1).groupBy("a").agg(F.array_sort(F.collect_list(F.struct("__p", "other", "score"))).alias("l"))
    rows = members.join(lists.join(others, "a"), F.col("cls") == F.col("a")).where("others > 0")
    rows = rows.select("i", "others", F.posexplode(F.slice(F.filter("l", lambda x: x["other"] != F.col("i")), 1, most)).alias("place", "x"))
    return rows.select("i", "others", "place", "x.other", "x.score")


def dealt(df: DataFrame, key: str) -> DataFrame:
    """df, dealt out by key if its input is in fewer pieces than there are cores: a file of one row group is one task."""
    few = df.rdd.getNumPartitions() < df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(key) if few else df


def checkpointed(df: DataFrame) -> DataFrame:
    """df cut from its lineage in the folder of spark.checkpoint.dir."""
    checkpoint_root(df.sparkSession)
    return df.checkpoint(eager=True)


def checkpoint_root(spark: SparkSession) -> None:
    """Sets the context's checkpoint folder from spark.checkpoint.dir; only a Spark of one process may do without that setting."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(folder or f"{tempfile.gettempdir()}/checkpoints")


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node and cluster, the smallest node reachable: single linkage by alternating stars.

    Each round ties every node to the smallest neighbour it knows, first its
    larger neighbours, then its smaller ones; minima combine before a shuffle, so
    a large cluster is no hot group.
    """
    now = checkpointed(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    state = None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("low"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(low, "a").where("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b"))
        now = checkpointed(small.unionByName(low.select("a", F.col("low").alias("b"))).distinct())
        seen = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        if state == (seen.n, seen.s):
            break
        state = (seen.n, seen.s)
    return nodes.select(F.col(nodes.columns[0]).alias("node")).join(now, F.col("node") == F.col("a"), "left").select("node", F.coalesce("b", "node").alias("cluster"))


def merged_bodies(df: DataFrame, cluster: str, idx: str, source: str, date: str, body: str, most: int = 6000) -> DataFrame:
    """One row per cluster as input of a report: cluster, lead, body, cluster_size, cluster_trimmed, cluster_sources, cluster_links and cluster_titles.

    The longest body leads, equal ones by idx. Members stand under headers, each
    cut to an even share of the budget at a blank line where one is late enough.
    A cluster of one keeps its body as it is. Columns link and title are used
    where df has them; missing sources are "unknown", in clusters of one "".
    """
    text = lambda c: F.coalesce(F.col(c), F.lit("")) if c in df.columns else F.lit("")
    # members meet in one array per cluster, which the budget needs at once; sizes are counted first so that a share is known before bodies travel
    sizes = df.groupBy(cluster).agg(F.count("*").alias("__n"))
    rows = df.join(sizes, cluster)
    share = F.greatest(F.lit(400), F.floor((F.lit(most) - F.col("__n") * 60) / F.col("__n")).cast("int"))
    rows = rows.withColumns({"__s": share, "__t": F.regexp_replace(text(body), r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")})
    head = F.left(F.col("__t"), F.col("__s"))
    back = F.instr(F.reverse(head), "\n\n")
    cut = F.when(back > 0, F.col("__s") - back - 1)
    cut = F.when(cut > F.floor(F.col("__s") / 2), cut).otherwise(F.col("__s"))
    long = F.length("__t") > F.col("__s")
    part = F.when(long, F.concat(F.regexp_replace(F.left(F.col("__t"), cut.cast("int")), r"[\s\p{Z}]+$", ""), F.lit(" […]"))).otherwise(F.col("__t"))
    named = F.coalesce(F.nullif(text(source), F.lit("")), F.lit("unknown"))
    header = F.concat(F.lit("["), named, F.lit(" — "), F.coalesce(F.nullif(text(date), F.lit("")), F.lit("no date")), F.lit("]\n"))
    alone = F.col("__n") == 1
    member = F.struct((-F.length(text(body))).alias("k"), F.col(idx).alias("i"), F.when(alone, text(body)).otherwise(F.concat(header, part)).alias("part"), F.when(alone, text(source)).otherwise(named).alias("source"), text("link").alias("link"), text("title").alias("title"), (long & ~alone).cast("int").alias("trimmed"))
    out = rows.groupBy(cluster).agg(F.array_sort(F.collect_list(member)).alias("m"))
    every = lambda name: F.transform("m", lambda x: x[name])
    return out.select(
        cluster,
        F.get("m", F.lit(0))["i"].alias("lead"),
        F.array_join(every("part"), "\n\n---\n\n").alias("body"),
        F.size("m").alias("cluster_size"),
        F.aggregate(every("trimmed"), F.lit(0), lambda a, x: a + x).alias("cluster_trimmed"),
        every("source").alias("cluster_sources"),
        every("link").alias("cluster_links"),
        every("title").alias("cluster_titles"),
    )
