"""Operator 8, benchmark decontamination: windows of test words looked up in every training text.

The benchmark's windows (runs of ``n`` words, or a whole shorter item) are the hash set. It is
shipped to every task as literals if it has at most ``set_windows`` members, which is checked by
counting; each training text then looks up the 64-bit hash of each of its windows, and a hit is
verified on the words themselves, all within one narrow pass. Of a larger set a sieve of fixed size
goes to every task; the positions whose hashes pass it are joined by shuffle with the set's, and
what meets is verified on the words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, lower_ascii, may_hold, sieve, text_or_empty, without

ADDED = ("n_words", "n_hit", "n_items", "items_sha256", "contaminated", "windows")
#: Between words: ASCII other than digits and letters (the text is in lower case by then).
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: str | Column) -> Column:
    """Words of a text in order, A-Z lowered; null and empty texts have none."""
    return F.filter(F.split(lower_ascii(text_or_empty(text)), GAP), lambda w: w != "")


def benchmark_windows(benchmark: DataFrame, n: int = 10, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(window, len, items): each distinct window and the ids, as strings, of the items that hold it."""
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), words(text_col).alias("w")).filter(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - (n - 1), F.lit(1)))
    found = items.select("item", F.explode(F.transform(starts, lambda i: F.slice("w", i, n))).alias("w"))
    return found.groupBy(F.array_join("w", " ").alias("window")).agg(F.max(F.size("w")).alias("len"), F.collect_set("item").alias("items"))


def _hashes(name: str, lengths: list[int]) -> tuple[list[dict[str, Column]], dict[int, str]]:
    """Steps of columns that end in an array of window hashes for each length, and their names.

    Hashes of 2, 4 and 8 words come from pairs of those of half the length, any other length from
    its powers of two, so a window of ten costs four combinations however long the text.
    """
    shifted = lambda a, k: F.slice(a, k + 1, F.greatest(F.size(a) - k, F.lit(0)))
    pair = lambda a, b, k: F.zip_with(F.slice(F.col(a), 1, F.greatest(F.size(b) - k, F.lit(0))), shifted(F.col(b), k), lambda x, y: F.xxhash64(x, y))
    steps, have = [{"_h1": F.transform(name, lambda w: F.xxhash64(w))}], {1: "_h1"}
    while max(have) * 2 <= max(lengths):
        k = max(have)
        steps.append({f"_h{2 * k}": pair(have[k], have[k], k)})
        have[2 * k] = f"_h{2 * k}"
    for length in lengths:
        at, rest = None, length
        for k in sorted((p for p in have if p & (p - 1) == 0), reverse=True):
            if rest >= k:
                done = length - rest
                if at is None:
                    at = have[k]
                else:
                    steps.append({f"_w{length}_{k}": pair(at, have[k], done)})
                    at = f"_w{length}_{k}"
                rest -= k
        have[length] = at
    return steps, {length: have[length] for length in lengths}


def window_hash(parts: Column, length: int) -> Column:
    """The same hash of one window's words as :func:`_hashes` gives."""

    def of(i: int, k: int) -> Column:
        return F.xxhash64(F.element_at(parts, i + 1)) if k == 1 else F.xxhash64(of(i, k // 2), of(i + k // 2, k // 2))

    at, rest, k = None, length, 1 << (length.bit_length() - 1)
    while rest:
        if rest >= k:
            new = of(length - rest, k)
            at, rest = new if at is None else F.xxhash64(at, new), rest - k
        k //= 2
    return at


def _looked_up(name: str, hashes: list[int], known: list[str], length: int) -> Column:
    """The windows at positions whose hash is known, less those that differ in their words.

    As SQL text, which is parsed at once: thousands of literals are slow to make one by one. Words
    hold no quotes, backslashes or other ASCII signs.
    """
    numbers, texts = ", ".join(f"{h}L" for h in hashes), ", ".join(f"'{w}'" for w in known)
    spots = f"filter(transform({name}, (h, i) -> CASE WHEN h IN ({numbers}) THEN i ELSE -1 END), i -> i >= 0)"
    spelled = f"transform({spots}, i -> struct(i AS pos, {length} AS len, array_join(slice(_w, i + 1, {length}), ' ') AS window))"
    return F.expr(f"filter({spelled}, x -> x.window IN ({texts}))")


def hits(docs: DataFrame, windows: DataFrame, set_windows: int = 200_000, text_col: str = "text") -> DataFrame:
    """``docs`` with ``n_words`` and ``windows``: (pos, len, window) of benchmark windows in the text, by position.

    Beyond ``set_windows`` the windows' hashes are joined by shuffle with those at each position, and
    what has an equal hash is given unverified. Columns of ``docs`` named as these two give way.
    """
    spark = docs.sparkSession
    lengths = sorted(r[0] for r in windows.select("len").distinct().collect())
    kept = [F.col(f"`{c}`") for c in without(docs, "n_words", "windows").columns]
    docs = docs.select(F.col(text_col).alias("text"), F.struct(*kept).alias("record"))
    worded = lambda df: df.withColumn("_w", words("text")).withColumn("n_words", F.size("_w").cast("long"))
    if not lengths:
        none = F.array().cast("array<struct<pos:int,len:int,window:string>>")
        return worded(docs).select("record.*", "n_words", none.alias("windows"))
    steps, names = _hashes("_w", lengths)
    known = windows.limit(set_windows + 1).select("window", "len").collect()
    if len(known) <= set_windows:
        docs = worded(docs)
        for step in steps:
            docs = docs.withColumns(step)
        found = []
        for k in lengths:
            ours = [r["window"] for r in known if r["len"] == k]
            parts = spark.createDataFrame([(w,) for w in ours], "w string").select(F.split("w", " ").alias("w"))
            hashes = [r[0] for r in parts.select(window_hash(F.col("w"), k)).collect()]
            found.append(_looked_up(names[k], hashes, ours, k))
        return docs.select("record.*", "n_words", (F.array_sort(F.concat(*found)) if len(found) > 1 else found[0]).alias("windows"))
    docs = checkpointed(docs.withColumn("row", F.monotonically_increasing_id()))
    hashed = worded(docs)
    for step in steps:
        hashed = hashed.withColumns(step)
    looked = None
    for k in lengths:
        mine = windows.filter(F.col("len") == k).select(window_hash(F.split("window", " "), k).alias("hash"), "len")
        looked = mine if looked is None else looked.unionByName(mine)
    looked = checkpointed(looked.distinct())
    bits = sieve(looked.select("hash"))
    at = [F.expr(f"transform({names[k]}, (h, i) -> struct(h AS hash, i AS pos, {k} AS len))") for k in lengths]
    spots = hashed.select("row", F.explode(F.concat(*at)).alias("x")).select("row", "x.*").filter(may_hold(bits, F.col("hash")))
    held = spots.join(looked, ["hash", "len"], "left_semi").groupBy("row").agg(F.array_sort(F.collect_list(F.struct("pos", "len"))).alias("spots"))
    spelled = F.transform("spots", lambda x: F.struct(x["pos"].alias("pos"), x["len"].alias("len"), F.array_join(F.slice("_w", x["pos"] + 1, x["len"]), " ").alias("window")))
    both = worded(docs.join(held, "row", "left"))
    return both.select("record.*", "n_words", F.coalesce(spelled, F.array().cast("array<struct<pos:int,len:int,window:string>>")).alias("windows"))


def covered(spans: Column) -> Column:
    """Words inside any of the spans (pos, len), which are in order of pos."""
    merged = F.aggregate(
        spans, F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")),
        lambda a, s: F.struct(F.greatest(a["end"], s["pos"] + s["len"]).alias("end"), (a["n"] + F.greatest(F.lit(0), s["pos"] + s["len"] - F.greatest(a["end"], s["pos"]))).alias("n")),
    )
    return merged["n"].cast("long")


def scan(docs: DataFrame, benchmark: DataFrame, n: int = 10, set_windows: int = 200_000, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row for each document: ``keep``, n_words, n_hit, n_items, items_sha256, contaminated.

    A null or empty text has no words and no hits; so has every text if the benchmark is empty or
    holds no words. Items with equal windows all count; windows of an item without an id hit, but it
    can't be named and doesn't count. Repeated documents give a row each; null ids are allowed.
    """
    windows = checkpointed(benchmark_windows(benchmark, n))
    found = hits(docs, windows, set_windows, text_col).select(*keep, "n_words", "windows").withColumn("_row", F.monotonically_increasing_id())
    each = found.select(*keep, "n_words", "_row", F.explode_outer("windows").alias("x")).select(*keep, "n_words", "_row", "x.*")
    known = windows.select("window", "items")
    if windows.count() <= set_windows:
        known = F.broadcast(known)
    each = each.join(known, "window", "left")
    sure = F.col("items").isNotNull()
    by_row = each.groupBy("_row").agg(
        *[F.first(c).alias(c) for c in (*keep, "n_words")], F.array_sort(F.collect_set(F.when(sure, F.struct("pos", "len")))).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("ids"),
    )
    n_hit = covered(F.col("spans"))
    return by_row.select(*keep, "n_words", n_hit.alias("n_hit"), F.size("ids").cast("long").alias("n_items"), F.sha2(F.array_join("ids", ",").cast("binary"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def remove_documents(docs: DataFrame, benchmark: DataFrame, n: int = 10, set_windows: int = 200_000, text_col: str = "text") -> DataFrame:
    """The documents without any benchmark window, in their own columns, whatever their names.

    Null and empty texts stay, and so does everything if the benchmark is empty. Repeated rows are
    judged alike and keep their number; an empty table gives no rows.
    """
    windows = checkpointed(benchmark_windows(benchmark, n))
    docs = docs.select(text_col, F.struct("*").alias("_record"))
    if windows.count() <= set_windows:
        # A filter isn't pushed below a generator: below it, the steps of the hash would be spelled out anew at each use.
        found = hits(docs, windows, set_windows, text_col).select("_record", F.explode_outer(F.array(F.size("windows"))).alias("_n"))
        return found.filter("_n = 0").select("_record.*")
    rowed = hits(docs, windows, set_windows, text_col).withColumn("_row", F.monotonically_increasing_id())
    rowed = checkpointed(rowed.withColumn("windows", F.array_distinct(F.transform("windows", lambda x: x["window"]))))
    bad = rowed.select("_row", F.explode("windows").alias("window")).join(windows.select("window"), "window", "left_semi").select("_row").distinct()
    return rowed.join(bad, "_row", "left_anti").select("_record.*")


def remove_spans(docs: DataFrame, benchmark: DataFrame, n: int = 10, set_windows: int = 200_000, text_col: str = "text") -> DataFrame:
    """``docs`` with the words of benchmark windows cut out of the text; beyond ``set_windows`` they are verified by a join.

    The gap after a removed word goes with it; all else stays to the letter. Null and empty texts
    stay as they are, repeated rows are cut alike and keep their number, an empty table gives no
    rows, and other columns stay whatever their names.
    """
    windows = checkpointed(benchmark_windows(benchmark, n))
    columns = docs.columns
    found = hits(docs.select(text_col, F.struct("*").alias("_record")), windows, set_windows, text_col)
    if windows.count() > set_windows:
        rowed = checkpointed(found.withColumn("_row", F.monotonically_increasing_id()))
        each = rowed.select("_row", F.explode("windows").alias("x")).select("_row", "x.*")
        sure = each.join(windows.select("window"), "window", "left_semi").groupBy("_row").agg(F.collect_set(F.struct("pos", "len")).alias("_sure"))
        none = F.array().cast("array<struct<pos:int,len:int>>")
        found = rowed.drop("windows").join(sure, "_row", "left").withColumn("windows", F.coalesce("_sure", none)).drop("_sure", "_row")
    pieces = F.split(text_col, r"(?<=[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F])(?=[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F])")
    lead = F.when(F.element_at(pieces, 1).rlike(r"\A[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*\z"), 1).otherwise(0)
    gone = F.array_distinct(F.flatten(F.transform("windows", lambda x: F.sequence(x["pos"], x["pos"] + x["len"] - 1))))
    left = F.array_except(F.sequence(F.lit(0), F.size("_pieces") - F.col("_lead") - 1), F.col("_gone"))
    kept = F.array_join(F.concat(F.slice("_pieces", 1, F.col("_lead")), F.transform(left, lambda i: F.element_at("_pieces", i + F.col("_lead") + 1))), "")
    cut = found.withColumns({"_pieces": pieces, "_lead": lead, "_gone": gone}).withColumn(text_col, F.when(F.size("windows") > 0, kept).otherwise(F.col(text_col)))
    return cut.select(*[F.col(text_col) if c == text_col else F.col(f"_record.`{c}`") for c in columns])
