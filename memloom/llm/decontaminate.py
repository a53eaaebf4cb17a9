"""Benchmark decontamination (operator 5), in DataFrame functions alone.

Texts and benchmark items are cut into words and turned into templates: a
number, a name (a capitalised word inside a sentence) or a unit after a number
becomes a placeholder of its type. Windows of eight template words are joined
by hash, so an item whose numbers, names or units were replaced still meets its
source. Windows with few words that are no placeholders, and items shorter than a
window, meet by their exact words instead. What stands in the slots is then
compared: in the windows that count along one alignment of text and item, the
same slot value of the item must always stand against the same value of the
text. A text holds an item if consistent windows cover 13 of its words, or all of
a shorter item.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW, COVERED, LITERALS = 8, 13, 5
#: Benchmark windows up to which that side is broadcast, and different hashes of them up to
#: which these alone are, to thin out the texts' windows; beyond, both sides are shuffled.
BROADCAST_WINDOWS, BROADCAST_HASHES = 1_000_000, 5_000_000
#: Units of measure and money.
UNITS = "mm cm m km g kg mg t l ml s ms min h hr hrs hz khz mhz ghz kb mb gb tb v w kw a n pa j kj mol ft in mi lb lbs oz inch inches foot feet yard yards mile miles pound pounds ounce ounces meter meters metre metres centimeter centimeters kilometer kilometers kilometre kilometres gram grams kilogram kilograms ton tons tonne tonnes liter liters litre litres second seconds minute minutes hour hours day days week weeks month months year years cent cents dollar dollars euro euros percent degree degrees".split()
_NAME, _JOIN = "\x02", "\x04"
_NAMES = r"(?<=[\p{L}\p{N},;:] )(?=\p{Lu}\p{Ll})"
_BREAK = r"(?:[^\p{L}\p{N}\x02\x04.,]|[.,](?!\d)|(?<!\d)[.,])+"


def words(text: Column) -> Column:
    """Lower-cased words; a name has a mark in front, and names in a row are one."""
    marked = F.regexp_replace(F.coalesce(text, F.lit("")), _NAMES, _NAME)
    return F.filter(F.split(F.lower(F.regexp_replace(marked, r"(\x02[\p{L}\p{N}]+) (?=\x02)", "$1" + _JOIN)), _BREAK), lambda w: w != "")


def _is_name(w: Column) -> Column:
    return w < "\x03"


def _is_number(w: Column) -> Column:
    return (w >= "0") & (w < ":")


def template(word_array: Column) -> Column:
    """Hash of each word; placeholders hash as their type."""
    units = F.array(*map(F.lit, UNITS))

    def one(w, i):
        after_number = F.coalesce(_is_number(F.get(word_array, i - 1)), F.lit(False))
        return F.when(_is_name(w), F.lit(1).cast("long")).when(_is_number(w), F.lit(2).cast("long")).when(after_number & F.array_contains(units, w), F.lit(3).cast("long")).otherwise(F.xxhash64(w))

    return F.transform(word_array, one)


def _windows(table: DataFrame, key: str, text: str) -> DataFrame:
    """(key, number of words, position, the window's own words, its hash) of every window:
    the hash of its template, or of its words where fewer than ``LITERALS`` of them are
    no placeholders. No row carries more of a text than its window."""
    # each explode of one array keeps the planner from computing that array again wherever it is used
    cut = table.select(F.col(key).alias("k"), F.explode(F.array(words(F.col(text)))).alias("words"))
    cut = cut.select("k", "words", F.explode(F.array(template(F.col("words")))).alias("h"))
    at = cut.where(F.size("h") >= WINDOW).select("k", "words", "h", F.explode(F.sequence(F.lit(0), F.size("h") - WINDOW)).alias("pos"))
    own = [F.get("h", F.col("pos") + i) for i in range(WINDOW)]
    literal = sum(((~h.isin(1, 2, 3)).cast("int") for h in own[1:]), (~own[0].isin(1, 2, 3)).cast("int"))
    return at.select("k", F.size("words").alias("of"), "pos", F.slice("words", F.col("pos") + 1, WINDOW).alias("words"), F.when(literal >= LITERALS, F.xxhash64(*own)).otherwise(F.xxhash64(_exact("pos", WINDOW))).alias("w"))


def _bare(w: Column) -> Column:
    return F.translate(w, _JOIN + _NAME, " ")


def _exact(pos: str, n: Column | int) -> Column:
    """The ``n`` words from a position, without marks, as one text."""
    return _bare(F.array_join(F.slice("words", F.col(pos) + 1, n), " "))


def _covered(at: Column) -> Column:
    """How many words the windows at these sorted positions cover."""
    n = F.size(at)
    gaps = F.zip_with(F.slice(at, F.lit(2), n), F.slice(at, F.lit(1), n - 1), lambda b, a: F.least(b - a, F.lit(WINDOW)))
    return F.when(n > 0, F.lit(WINDOW) + F.aggregate(gaps, F.lit(0), lambda acc, x: acc + x)).otherwise(0)


def _agree(pairs: Column) -> Column:
    return F.size(F.array_distinct(F.transform(pairs, lambda x: x["a"]))) == F.size(F.array_distinct(pairs))


_LINE = "struct<at:array<int>,pairs:array<struct<a:string,b:string>>>"


def _consistent(windows: Column) -> Column:
    """(at, pairs) of windows of one line that agree with each other.

    All of them if they do. Otherwise each window is tried as the first: those
    behind it, then those before it, join if they agree with what is there, and
    the choice that covers most words counts. Windows that follow each other
    and agree are so never lost to one elsewhere.
    """
    sound = F.filter(windows, lambda x: _agree(x["pairs"]))
    every = F.struct(F.transform(sound, lambda x: x["ipos"]).alias("at"), F.array_distinct(F.flatten(F.transform(sound, lambda x: x["pairs"]))).alias("pairs")).cast(_LINE)
    clash = lambda acc, x: F.exists(x["pairs"], lambda p: F.exists(acc["pairs"], lambda q: (p["a"] == q["a"]) & (p["b"] != q["b"])))
    join = lambda acc, x: F.when(clash(acc, x), acc).otherwise(F.struct(F.concat(acc["at"], F.array(x["ipos"])).alias("at"), F.array_union(acc["pairs"], x["pairs"]).alias("pairs")))
    none = F.struct(F.array().cast("array<int>").alias("at"), F.array().cast("array<struct<a:string,b:string>>").alias("pairs")).cast(_LINE)

    def choice(i):
        order = F.concat(F.slice(sound, i, F.size(sound)), F.reverse(F.slice(sound, F.lit(1), i - 1)))
        return F.aggregate(order, none, join, lambda acc: F.struct(_covered(F.array_sort(acc["at"])).alias("n"), F.array_sort(acc["at"]).alias("at"), acc["pairs"].alias("pairs")))

    best = F.array_max(F.transform(F.sequence(F.lit(1), F.size(sound)), choice))
    return F.when(_agree(every["pairs"]), every).otherwise(F.struct(best["at"].alias("at"), best["pairs"].alias("pairs")).cast(_LINE))


def _short(docs: DataFrame, items: DataFrame) -> DataFrame | None:
    """(k, item, covered, changed): texts that hold all words of an item shorter than a window."""
    n = F.size("words")
    items = items.select("item", words(F.col("t")).alias("words")).where((n > 0) & (n < WINDOW)).select("item", n.alias("n"), F.lit(0).alias("pos"), "words").select("item", F.col("n").alias("of"), _exact("pos", F.col("n")).alias("exact")).distinct()
    lengths = sorted(r[0] for r in items.select("of").distinct().collect())  # fewer than a window has words
    if not lengths:
        return None
    if items.limit(BROADCAST_WINDOWS + 1).count() <= BROADCAST_WINDOWS:
        items = F.broadcast(items)  # the size was just checked
    cut = docs.select("k", F.explode(F.array(words(F.col("t")))).alias("words"))
    cut = cut.select("k", "words", F.explode(F.array(*map(F.lit, lengths))).alias("n")).where(F.size("words") >= F.col("n"))
    cut = cut.select("k", "words", "n", F.explode(F.sequence(F.lit(0), F.size("words") - F.col("n"))).alias("pos")).select("k", "n", _exact("pos", F.col("n")).alias("x"))
    met = cut.join(items, (F.col("n") == F.col("of")) & (F.col("x") == F.col("exact")))
    return met.select("k", "item", F.col("n").cast("long").alias("covered"), F.lit(False).alias("changed")).distinct()


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """Documents that hold a benchmark item, verbatim or re-parameterised.

    Result, one row per document id that holds any: the id column, ``n_items``
    long, ``items`` array (sorted), ``covered`` long (words of the best covered
    item) and ``changed`` boolean (some slot of a held item has another value).
    Items of fewer words than a window, and windows with fewer than five words
    that are no placeholders, are found as exact copies only. Null texts and
    items without words match nothing. Rows that repeat an id
    are one document. Empty tables give an empty result.
    """
    texts = docs.select(F.col(id_col).alias("k"), F.col(text_col).alias("t"))
    listed = benchmark.where(F.col(item_col).isNotNull()).select(F.col(item_col).alias("item"), F.col(item_text).alias("t"))
    items = _windows(listed, "item", "t")
    items = items.select(F.col("k").alias("item"), F.col("pos").alias("ipos"), F.col("words").alias("iwords"), "of", F.col("w").alias("iw"))
    windows = _windows(texts, "k", "t").drop("of")
    if items.limit(BROADCAST_WINDOWS + 1).count() <= BROADCAST_WINDOWS:
        items = F.broadcast(items)  # the size was just checked
    else:
        hashes = items.select(F.col("iw").alias("w")).distinct()
        if hashes.limit(BROADCAST_HASHES + 1).count() <= BROADCAST_HASHES:
            windows = windows.join(F.broadcast(hashes), "w", "left_semi")  # likewise
    met = windows.join(items, F.col("w") == F.col("iw"))
    slot = lambda x: _is_name(x["a"]) | _is_number(x["a"]) | x["a"].isin(UNITS)
    pairs = F.filter(F.zip_with("iwords", "words", lambda a, b: F.struct(a.alias("a"), b.alias("b"))), slot)
    pairs = F.transform(pairs, lambda x: F.struct(x["a"].alias("a"), _bare(x["b"]).alias("b")))
    met = met.select("k", "item", "of", "ipos", (F.col("pos") - F.col("ipos")).alias("shift"), pairs.alias("pairs"))
    line = met.groupBy("k", "item", "of", "shift").agg(F.array_sort(F.collect_set(F.struct("ipos", "pairs"))).alias("windows"))
    # each explode of one array keeps the planner from choosing again wherever the choice is used
    line = line.select("k", "item", "of", F.explode(F.array(_consistent(F.col("windows")))).alias("line")).select("k", "item", "of", "line.at", "line.pairs").where(F.size("at") > 0)
    whole = line.groupBy("k", "item", "of").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("at")))).alias("at"), F.max(F.exists("pairs", lambda x: _bare(x["a"]) != x["b"])).alias("changed"))
    held = whole.withColumn("covered", _covered(F.col("at")).cast("long")).where(F.col("covered") >= F.least(F.col("of"), F.lit(COVERED))).select("k", "item", "covered", "changed")
    short = _short(texts, listed)
    held = held if short is None else held.union(short)
    return held.groupBy(F.col("k").alias(id_col)).agg(F.count(F.lit(1)).alias("n_items"), F.array_sort(F.collect_set("item")).alias("items"), F.max("covered").alias("covered"), F.max("changed").alias("changed"))
