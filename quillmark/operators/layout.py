"""Word boxes of pages to lines, columns and text.

Input: (doc_id, page, word_ord, x, y, width, height, text); gutters, columns and their
text also take documents of one row each (``documents``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PAGE = ["doc_id", "page"]


def y_tolerance(words: DataFrame, keys: list[str] = PAGE) -> DataFrame:
    """Line tolerance of each page: 4 with fewer than 10 places, else one and a half
    times the median of the gaps that are not above the median gap, between 2 and 8."""
    ys = words.select(*keys, "y").distinct()
    gaps = ys.withColumn("gap", F.col("y") - F.lag("y").over(Window.partitionBy(*keys).orderBy("y"))).where(F.col("gap").isNotNull())
    mid = gaps.groupBy(*keys).agg(F.percentile("gap", F.lit(0.5)).alias("mid"))
    small = gaps.join(mid, keys).where(F.col("gap") <= F.col("mid")).groupBy(*keys).agg(F.percentile("gap", F.lit(0.5)).alias("m"))
    n = words.groupBy(*keys).agg(F.count("y").alias("n"))
    tol = F.when(F.col("n") < 10, 4.0).otherwise(F.coalesce(F.least(F.greatest(F.ceil(F.col("m") * 1.5), F.lit(2)), F.lit(8)).cast("double"), F.lit(4.0)))
    return n.join(small, keys, "left").select(*keys, tol.alias("tolerance"))


def lines(words: DataFrame, keys: list[str] = PAGE) -> DataFrame:
    """(keys, line_y, line): words of one line (half-even binning of y) from left to right."""
    binned = words.join(y_tolerance(words, keys), keys).withColumn("line_y", F.rint(F.col("y") / F.col("tolerance")) * F.col("tolerance"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x", "word_ord", "text"))), lambda w: w["text"]), " ")
    return binned.groupBy(*keys, "line_y").agg(text.alias("line"), F.min("x").alias("line_x"), F.count("*").alias("n_words"))


def is_title(line: Column) -> Column:
    """Short lines in capitals or with a section number."""
    return (F.length(line) < 80) & ((line.rlike(r"^[A-Z0-9 ,:;&()/\-]+$") & line.rlike("[A-Z]")) | line.rlike(r"^\d+\.\s") | line.rlike(r"^\d+\.\d+"))


def page_text(lined: DataFrame, keys: list[str] = PAGE) -> DataFrame:
    """Text of each page: titles and references stand apart, other lines run on."""
    w = Window.partitionBy(*keys).orderBy("line_y")
    apart = is_title(F.col("line")) | is_title(F.lag("line").over(w)) | F.col("line").rlike(r"^\[\d+\]")
    sep = F.when(F.lag("line").over(w).isNull(), "").when(apart, "\n\n").otherwise(" ")
    parts = lined.withColumn("piece", F.concat(sep, "line"))
    return parts.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_y", "piece"))), lambda x: x["piece"]), "").alias("text"))


def running_headers(lined: DataFrame) -> DataFrame:
    """(doc_id, signature): first 40 characters of first lines found on three pages or more."""
    first = lined.withColumn("k", F.row_number().over(Window.partitionBy(*PAGE).orderBy("line_y"))).where("k = 1")
    return first.groupBy("doc_id", F.substring("line", 1, 40).alias("signature")).agg(F.count("*").alias("n_pages")).where("n_pages >= 3")


def without_running_headers(lined: DataFrame) -> DataFrame:
    """Lines without the running headers at the top of pages."""
    top = F.row_number().over(Window.partitionBy(*PAGE).orderBy("line_y"))
    rows = lined.withColumn("signature", F.when(top == 1, F.substring("line", 1, 40)))
    return rows.join(running_headers(lined).select("doc_id", "signature"), ["doc_id", "signature"], "left_anti").drop("signature")


def _let(value: Column, f) -> Column:
    """[f(value)], with ``value`` computed once however often ``f`` names it."""
    return F.transform(F.array(value), f)


def _median(values: Column) -> Column:
    ordered = F.struct(F.sort_array(F.array_compact(values)).alias("v"))
    return F.get(_let(ordered, lambda o: F.get(o["v"], F.floor((F.size(o["v"]) - 1) / 2).cast("int")) * 0.5 + F.get(o["v"], F.floor(F.size(o["v"]) / 2).cast("int")) * 0.5), 0)


def packed(words: DataFrame, keys: list[str] = PAGE) -> DataFrame:
    """(keys, words): the boxes of each page in one row, as an array of (y, x, word_ord, text)."""
    return words.groupBy(*keys).agg(F.collect_list(F.struct("y", "x", "word_ord", "text")).alias("words"))


def documents(words: DataFrame) -> DataFrame:
    """(doc_id, pages): the boxes of each document in one row, as an array of (page, words).

    Boxes that are stored so already stay as they are: all that follows is then
    done where the row is, without a shuffle of words.
    """
    if "pages" in words.columns:
        return words
    return packed(words).groupBy("doc_id").agg(F.collect_list(F.struct("page", "words")).alias("pages"))


def _page_rows(words: DataFrame, keys: list[str]) -> DataFrame:
    # Outer, as an inner one has a filter on its input inferred, which computes the pages twice.
    return words.select("doc_id", F.inline_outer("pages")) if "pages" in words.columns else packed(words, keys)


def _split(words: Column, bins: int = 49) -> Column:
    """[(threshold, n, n_left)] of one page, none for fewer than two words.

    The best split of x into two clusters by least squares, exactly, from running
    sums; then the right edge of the first emptiest bin between the centres. A split
    inside a run of equal x never beats both ends of the run (the sum of squares is
    convex there), so only these, the first known x and the last place but one are tried.
    """
    best = "struct<score:double,x:double,k:int,s:double>"

    def runs(p):
        n, end = F.size(p["xs"]), lambda x, k: F.struct(x.alias("x"), k.cast("int").alias("k"))
        # Up to 16 places are searched for, which takes less than to look at each word; more are seen word by word.
        found = F.transform(p["places"], lambda x, j: end(x, F.coalesce(F.array_position(p["xs"], F.get(p["places"], j + 1)) - 1, n)))
        found = F.concat(F.slice(found, F.lit(1), F.size(found) - 1), F.array(end(F.get(p["xs"], n - 1), n - 1), end(F.get(p["xs"], n - 1), n)))
        seen = F.array_compact(F.transform(p["xs"], lambda x, i: F.when(~x.eqNullSafe(F.get(p["xs"], i + 1)) | (i >= p["last"]) | (i == p["unknown"]), end(x, i + 1))))
        return F.struct(F.when((p["unknown"] == 0) & (F.size(p["places"]) <= 16), found).otherwise(seen).alias("runs"), n.alias("n"))

    def weighted(p):
        m = F.transform(p["runs"], lambda r, i: F.struct(r["x"].alias("x"), r["k"].alias("k"), (r["k"] - F.coalesce(F.get(p["runs"], i - 1)["k"], F.lit(0))).alias("m")))
        return F.struct(m.alias("runs"), p["n"].alias("n"), F.aggregate(m, F.lit(0.0), lambda a, r: a + F.coalesce(r["x"] * r["m"], F.lit(0.0))).alias("t"))

    def step(a, r, n, t):
        x, k, s = r["x"], r["k"], a["s"] + F.coalesce(r["x"] * r["m"], F.lit(0.0))
        score, known = s * s / k + (t - s) * (t - s) / (n - k), lambda v: F.when(x.isNotNull(), v)
        return F.struct(s.alias("s"), F.greatest(a["b"], F.when(k < n, F.struct(known(score).alias("score"), x.alias("x"), k.alias("k"), known(s).alias("s")))).alias("b"))

    def centres(p):
        none = F.struct(F.lit(0.0).alias("s"), F.lit(None).cast(best).alias("b"))
        b = F.aggregate(p["runs"], none, lambda a, r: step(a, r, p["n"], p["t"]), lambda a: a["b"])
        return F.struct(p["runs"].alias("runs"), p["n"].alias("n"), p["t"].alias("t"), b.alias("b"))

    def sides(c):
        return F.struct(c["runs"].alias("runs"), c["n"].alias("n"), c["b"]["k"].alias("k"), (c["b"]["s"] / c["b"]["k"]).alias("l"), ((c["t"] - c["b"]["s"]) / (c["n"] - c["b"]["k"])).alias("r"))

    def filled(c):
        inside = F.filter(c["runs"], lambda r: (r["x"] >= c["l"]) & (r["x"] <= c["r"]))
        at = lambda x: F.least(F.floor(F.try_divide(x - c["l"], (c["r"] - c["l"]) / bins)) + 1, F.lit(bins)).cast("int")
        return F.struct(c["n"].alias("n"), c["k"].alias("k"), c["l"].alias("l"), c["r"].alias("r"), F.transform(inside, lambda r: F.struct(at(r["x"]).alias("bin"), r["m"].alias("m"))).alias("at"))

    def edge(c):
        every = F.sequence(F.lit(1), F.lit(bins))
        weight = lambda i: F.aggregate(c["at"], F.lit(0), lambda a, r: a + F.when(r["bin"] == i, r["m"]).otherwise(0))
        fewest = F.array_min(F.transform(every, lambda i: F.struct(weight(i).alias("m"), i.alias("bin"))))["bin"]
        b = F.coalesce(F.get(F.array_except(every, c["at"]["bin"]), 0), fewest)
        return F.struct((c["l"] + b * (c["r"] - c["l"]) / bins).alias("threshold"), c["n"].alias("n"), c["k"].alias("n_left"))

    def told(p):
        unknown = F.when(F.get(p["xs"], 0).isNull(), F.size(F.filter(p["xs"], F.isnull))).otherwise(0)
        return F.struct(p["xs"].alias("xs"), F.array_distinct(p["xs"]).alias("places"), (F.size(p["xs"]) - 2).alias("last"), unknown.alias("unknown"))

    page = F.filter(F.transform(_let(F.struct(F.sort_array(words["x"]).alias("xs")), lambda p: p), told), lambda p: p["last"] >= 0)
    for part in (runs, weighted, centres, sides, filled, edge):
        page = F.transform(page, part)
    return page


def gutter(words: DataFrame, keys: list[str] = PAGE, bins: int = 49) -> DataFrame:
    """(keys, threshold): right edge of the first emptiest of 49 bins between the centres."""
    return _page_rows(words, keys).select(*keys, F.inline(_split(F.col("words"), bins)))


def _two_columns(words: Column, threshold: Column) -> Column:
    """Whether both sides have five words and three lines each and overlap in y by 30 percent."""
    def side(ws):
        y = F.array_distinct(ws["y"])
        lines = F.array_distinct(F.transform(F.array_compact(y), lambda v: F.rint(v / 4)))
        return F.struct(F.size(ws).alias("n"), F.array_min(y).alias("low"), F.array_max(y).alias("high"), F.size(lines).alias("lines"))

    def good(p):
        a, b = p["l"], p["r"]
        overlap = F.try_divide(F.least(a["high"], b["high"]) - F.greatest(a["low"], b["low"]), F.greatest(a["high"], b["high"]) - F.least(a["low"], b["low"]))
        return F.coalesce((a["n"] >= 5) & (b["n"] >= 5) & (overlap >= 0.3) & (a["lines"] >= 3) & (b["lines"] >= 3), F.lit(False))

    left, right = (F.get(_let(F.filter(words, c), side), 0) for c in (lambda w: w["x"] < threshold, lambda w: w["x"] >= threshold))
    return F.get(_let(F.struct(left.alias("l"), right.alias("r")), good), 0)


def valid_columns(words: DataFrame, thresholds: DataFrame, keys: list[str] = PAGE) -> DataFrame:
    """Pages whose two sides have five words and three lines each and overlap in y by 30 percent."""
    rows = _page_rows(words, keys).join(thresholds.select(*keys, "threshold"), keys)
    return rows.select(*keys, _two_columns(F.col("words"), F.col("threshold")).alias("two_columns"))


def page_columns(words: DataFrame, keys: list[str] = PAGE) -> DataFrame:
    """(keys, two_columns): ``valid_columns`` of each page by its own gutter."""
    told = F.transform(_split(F.col("words")), lambda g: F.struct(_two_columns(F.col("words"), g["threshold"]).alias("two_columns")))
    return _page_rows(words, keys).select(*keys, F.inline(told))


def _global(pages: Column) -> Column:
    """(threshold, n_pages) of one document."""
    def told(p):
        n, left = lambda g: g["n"], lambda g: g["n_left"]
        balanced = lambda g: F.greatest(left(g), n(g) - left(g)) <= 3 * F.least(left(g), n(g) - left(g))
        good = F.transform(F.filter(_split(p["words"]), lambda g: (n(g) >= 30) & balanced(g)), lambda g: g["threshold"])
        return F.filter(good, lambda t: _two_columns(p["words"], t))

    thresholds = F.struct(F.flatten(F.transform(pages, told)).alias("t"))
    return F.get(_let(thresholds, lambda d: F.struct(_median(d["t"]).alias("threshold"), F.size(d["t"]).cast("long").alias("n_pages"))), 0)


def global_gutter(words: DataFrame) -> DataFrame:
    """(doc_id, threshold): median over valid pages of 30 words or more with balanced sides."""
    return documents(words).select("doc_id", F.inline(F.filter(F.array(_global(F.col("pages"))), lambda g: g["n_pages"] > 0)))


def _lines(words: Column) -> Column:
    """[(line_y, line, line_x, n_words)] of some words, as ``lines``."""
    def gaps(p):
        below = F.slice(p["ys"], F.lit(2), F.greatest(F.size(p["ys"]) - 1, F.lit(0)))
        return F.struct(p["w"].alias("w"), p["n"].alias("n"), F.transform(below, lambda y, i: y - F.get(p["ys"], i)).alias("gaps"))

    def middle(p):
        return F.struct(p["w"].alias("w"), p["n"].alias("n"), p["gaps"].alias("gaps"), _median(p["gaps"]).alias("mid"))

    def tolerance(p):
        m = _median(F.filter(p["gaps"], lambda g: g <= p["mid"]))
        tol = F.when(p["n"] < 10, 4.0).otherwise(F.coalesce(F.least(F.greatest(F.ceil(m * 1.5), F.lit(2)), F.lit(8)).cast("double"), F.lit(4.0)))
        return F.struct(p["w"].alias("w"), p["w"]["y"].alias("y"), tol.alias("tol"))

    def runs(p):
        begins = F.transform(p["w"]["y"], lambda y, i: F.when(~y.eqNullSafe(F.get(p["y"], i - 1)) | (i == 0), i))
        ats = F.transform(F.array_compact(begins), lambda i: F.struct((F.rint(F.get(p["y"], i) / p["tol"]) * p["tol"]).alias("line_y"), i.alias("at")))
        return F.struct(p["w"].alias("w"), ats.alias("runs"))

    def starts(p):
        first = F.filter(p["runs"], lambda r, j: (j == 0) | ~F.get(p["runs"], j - 1)["line_y"].eqNullSafe(r["line_y"]))
        return F.struct(p["w"].alias("w"), first.alias("at"))

    def cut(p):
        def line(r, j):
            last = F.coalesce(F.get(p["at"], j + 1)["at"], F.size(p["w"]))
            return F.transform(F.array(F.slice(p["w"], r["at"] + 1, last - r["at"])), lambda ws: told(r, ws))

        def told(r, ws):
            even = F.get(ws, 0)["y"].eqNullSafe(F.get(ws, F.size(ws) - 1)["y"])
            by_x = F.sort_array(F.transform(ws, lambda w: F.struct(w["x"].alias("x"), w["word_ord"].alias("word_ord"), w["text"].alias("text"))))
            return F.struct(r["line_y"].alias("line_y"), F.array_join(F.when(even, ws["text"]).otherwise(by_x["text"]), " ").alias("line"), F.array_min(ws["x"]).alias("line_x"), F.size(ws).cast("long").alias("n_words"))

        return F.flatten(F.transform(p["at"], line))

    def places(w):
        y = w["y"]
        known = F.when(F.get(y, 0).isNull(), F.size(F.array_compact(y))).otherwise(F.size(y))
        return F.struct(w.alias("w"), known.alias("n"), F.array_compact(F.array_distinct(y)).alias("ys"))

    # By y, x and place: lines are runs of y, as the binning keeps the order.
    page = _let(F.sort_array(words), places)
    for part in (gaps, middle, tolerance, runs, starts, cut):
        page = F.transform(page, part)
    return F.get(page, 0)


def _by_column(pages: Column, threshold: Column) -> Column:
    """[(page, column, words)] of one document: left of the threshold first; one column where there is none."""
    def sides(p):
        words = p["words"]
        left = F.when(threshold.isNull(), words).otherwise(F.filter(words, lambda w: w["x"] < threshold))
        right = F.when(threshold.isNotNull(), F.filter(words, lambda w: F.coalesce(w["x"] >= threshold, F.lit(True))))
        side = lambda k, ws: F.struct(p["page"].alias("page"), F.lit(k).alias("column"), ws.alias("words"))
        return F.array(side(1, left), side(2, right))

    return F.filter(F.flatten(F.transform(pages, sides)), lambda c: F.size(c["words"]) > 0)


def column_lines(words: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Lines by column: left of the document's threshold first; one column where it has none."""
    rows = documents(words).join(thresholds.select("doc_id", "threshold"), "doc_id", "left")
    columns = rows.select("doc_id", F.inline_outer(_by_column(F.col("pages"), F.col("threshold"))))
    return columns.select("doc_id", "page", "column", F.inline(_lines(F.col("words"))))


def _joined(lines: Column) -> Column:
    """Text of some lines in order, as ``page_text``."""
    def told(p):
        def piece(line, i):
            apart = F.get(p["titles"], i) | F.get(p["titles"], i - 1) | line.rlike(r"^\[\d+\]")
            return F.concat(F.when(i == 0, "").when(apart, "\n\n").otherwise(" "), line)

        return F.array_join(F.transform(p["lines"], piece), "")

    return F.get(F.transform(_let(lines["line"], lambda x: F.struct(x.alias("lines"), F.transform(x, is_title).alias("titles"))), told), 0)


def _column_texts(pages: Column) -> Column:
    """[(page, column, text)] of one document, its columns cut at its own threshold."""
    told = lambda d: F.transform(F.get(_let(d["g"]["threshold"], lambda t: _by_column(d["pages"], t)), 0), lambda c: F.struct(c["page"].alias("page"), c["column"].alias("column"), _joined(_lines(c["words"])).alias("text")))
    return F.get(F.transform(_let(pages, lambda p: F.struct(p.alias("pages"), _global(p).alias("g"))), told), 0)


def column_texts(words: DataFrame) -> DataFrame:
    """(doc_id, page, column, text): text of each column of a document's pages."""
    return documents(words).select("doc_id", F.inline(_column_texts(F.col("pages"))))


def interleaved(docs: DataFrame, text: str = "text") -> DataFrame:
    """Whether a text reads as if columns were mixed: of ten or more sentences many are
    short or start in lower case."""
    s = docs.select("doc_id", F.explode(F.split(text, r"[.!?]\s+", -1)).alias("s")).where(F.length("s") > 20)
    mid = s.groupBy("doc_id").agg(F.percentile(F.length("s"), F.lit(0.5)).alias("mid"), F.count("*").alias("n"))
    a = s.join(mid, "doc_id").groupBy("doc_id", "n").agg(F.avg((F.length("s") < 0.3 * F.col("mid")).cast("int")).alias("short"), F.avg(F.col("s").rlike("^[a-z]").cast("int")).alias("lower"))
    return a.select("doc_id", ((F.col("n") >= 10) & ((F.col("short") > 0.4) | (F.col("lower") > 0.3))).alias("interleaved"))


def without_first_page_header(lined: DataFrame) -> DataFrame:
    """Page 1 without what stands above its Introduction, where a journal's marker stands there."""
    first = F.col("page") == 1
    marker = F.max(F.when(first & F.col("line").rlike(r"(?i)journal|issn|doi|volume|received|accepted|elsevier|springer|wiley"), 1).otherwise(0)).over(Window.partitionBy("doc_id"))
    intro = F.min(F.when(first & F.col("line").rlike(r"(?i)^\s*(?:\d+\.?\s*)?introduction\b"), F.col("line_y"))).over(Window.partitionBy("doc_id"))
    rows = lined.withColumn("_m", marker).withColumn("_i", intro)
    return rows.where(~(first & (F.col("_m") == 1) & F.col("_i").isNotNull() & (F.col("line_y") < F.col("_i")))).drop("_m", "_i")


def without_first_page_footer(lined: DataFrame) -> DataFrame:
    """Page 1 without its footer: from the first footer marker in the lowest quarter on."""
    first = F.col("page") == 1
    w = Window.partitionBy(*PAGE)
    low, high = F.min("line_y").over(w), F.max("line_y").over(w)
    rows = lined.withColumn("_q", low + (high - low) * 0.75)
    marker = first & (F.col("line_y") >= F.col("_q")) & F.col("line").rlike(r"(?i)correspond|e-?mail|received|copyright|©|https?://|doi\.org|published by|all rights")
    rows = rows.withColumn("_f", F.min(F.when(marker, F.col("line_y"))).over(w))
    return rows.where(~(first & F.col("_f").isNotNull() & (F.col("line_y") >= F.col("_f")))).drop("_q", "_f")


def assign_columns(words: DataFrame, n_columns: int, thresholds: DataFrame | None = None, keys: list[str] = PAGE) -> DataFrame:
    """Words with their column of ``n_columns``: one more than the thresholds to their
    left (a word on a threshold is left of it). Without ``thresholds`` (keys,
    thresholds array) the width of the page is cut into equal parts."""
    if thresholds is None:
        low, high = F.min("x"), F.max("x")
        cut = F.transform(F.sequence(F.lit(1), F.lit(n_columns - 1)), lambda k: F.col("low") + (F.col("high") - F.col("low")) / n_columns * k) if n_columns > 1 else F.array().cast("array<double>")
        thresholds = words.groupBy(*keys).agg(low.alias("low"), high.alias("high")).select(*keys, cut.alias("thresholds"))
    rows = words.join(thresholds.select(*keys, "thresholds"), keys)
    return rows.withColumn("column", (F.size(F.filter("thresholds", lambda t: F.col("x") > t)) + 1)).drop("thresholds")


# Rewrites of joined pages, in their order.
PAGE_TIDY = (
    (r"([0-9]+(?:\.[0-9]+)*\.\s+[A-Z][A-Za-z\s]{3,50})", "\n\n$1"), (r"\s+([A-Z][A-Z\s]{10,60})\s+", "\n\n$1\n\n"), (r"([.!?])\s+([A-Z][a-z])", "$1\n\n$2"), (r"\n{3,}", "\n\n"),
    (r"-\s*\n", ""), (r"-\s+", ""), (r"[ \t]+", " "), (r"\n ", "\n"), (r"^\s+|\s+$", ""),
)


def _tidy(text: Column) -> Column:
    for pattern, to in PAGE_TIDY:
        text = F.regexp_replace(text, pattern, to)
    return text


def joined_pages(pages: DataFrame) -> DataFrame:
    """Pages of a document in order; numbered and capital headings and sentences apart,
    hyphens at line ends and white space tidied."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "text"))), lambda x: x["text"]), "\n\n")
    t = pages.groupBy("doc_id").agg(text.alias("text"))
    return t.select("doc_id", _tidy(F.col("text")).alias("text"))


def _tidied(texts: Column) -> Column:
    """One text of [(page, column, text)], as ``joined_pages``."""
    ordered = F.sort_array(F.transform(texts, lambda t: F.struct((t["page"] * 10 + t["column"]).alias("at"), t["text"].alias("text"))))
    return _tidy(F.array_join(ordered["text"], "\n\n"))


def document_text(words: DataFrame, plain: DataFrame | None = None, least: int = 100) -> DataFrame:
    """(doc_id, text): the columns' text of each document's word boxes; the plain text
    (doc_id, text) where that is missing or shorter than ``least``. Without ``plain``
    it is a column of that name beside the boxes."""
    docs = documents(words)
    laid = docs.select("doc_id", _tidied(_column_texts(F.col("pages"))).alias("laid"), *(["plain"] if plain is None else []))
    both = laid if plain is None else laid.join(plain.select("doc_id", F.col("text").alias("plain")), "doc_id", "full")
    return both.select("doc_id", F.when(F.coalesce(F.length("laid"), F.lit(0)) < least, F.coalesce("plain", "laid")).otherwise(F.col("laid")).alias("text"))
