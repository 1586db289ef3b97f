"""Word boxes of pages: lines, scanned trades, and schedules of holdings that stand in columns.

What is local to a word or a line is built-in expressions; what depends on the rows before it, within one page or one
report, is a window, or a fold over that page's or report's sorted array.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.labels import named, owner, type_word
from ..functions.money import amount_range, asset_value, begins_with, squeezed
from ..functions.text import asset_class, canonical_ticker, loose_date
from ..sources.kept import kept

# How far words of one line lie apart at most: in a scan at least LEAST units, else a share of the median height.
LEAST_GAP, GAP_SHARE, DEFAULT_HEIGHT = 8.0, 0.55, 12.0
TEXT_GAP = 3.0
# What a scanned trade needs.
MIN_CONFIDENCE, FIRST_YEAR = 60, 2012


def _numbered(words: Column, near: Callable[[Column, Column], Column], moved: Callable[[Column, Column, Column], Column]) -> Column:
    """The line, from 0, of each word of a sorted array with a field at. near: whether a word belongs to the line at some
    height; moved: the line's height with that word, given the height and the number of words before.
    """

    def step(acc: Column, w: Column) -> Column:
        joins = F.coalesce(near(acc["at"], w["at"]), F.lit(False))
        line = F.when(joins, acc["line"]).otherwise(acc["line"] + 1)
        return F.struct(
            F.when(joins, moved(acc["at"], w["at"], acc["n"])).otherwise(w["at"]).alias("at"), F.when(joins, acc["n"] + 1).otherwise(1).alias("n"), line.alias("line"),
            F.concat(acc["lines"], F.array(line)).alias("lines"),
        )

    start = F.struct(F.lit(None).cast("double").alias("at"), F.lit(0).alias("n"), F.lit(-1).alias("line"), F.array().cast("array<int>").alias("lines"))
    return F.aggregate(words, start, step, lambda acc: acc["lines"])


def _lines(words: DataFrame, fields: list[str], near, moved) -> DataFrame:
    """(doc, page, line, words): words as an array of fields from left to right; near and moved may read the page's median height."""
    page = words.groupBy("doc", "page").agg(F.array_sort(F.collect_list(F.struct("at", "x", *fields))).alias("_words"), F.array_sort(F.collect_list("height")).alias("_heights"))
    page = page.withColumn("_median", F.coalesce(F.get("_heights", F.floor(F.size("_heights") / 2).cast("int")), F.lit(DEFAULT_HEIGHT)))
    page = page.select("doc", "page", F.explode(F.arrays_zip(_numbered(F.col("_words"), near, moved).alias("line"), F.col("_words").alias("word"))).alias("w"))
    of_line = F.sort_array(F.collect_list(F.struct("w.word.x", "w.word.at", *(f"w.word.{f}" for f in fields))))
    return page.groupBy("doc", "page", F.col("w.line").alias("line")).agg(of_line.alias("words"))


def scan_lines(words: DataFrame) -> DataFrame:
    """(doc, page, line, words, text) of scanned words (doc, page, text, confidence, x, y, x1, y1).

    From the top down, a word joins the line whose middle, the mean of its words so far, is near enough; else it begins the
    next. So a slanted line stays one, and lines that lie close stay apart. Blank words are left out; a page without words has no line.
    """
    x = words.where(F.trim("text") != "").select(
        "doc", "page", "text", "confidence", F.col("x").cast("double").alias("x"), ((F.col("y") + F.col("y1")) / 2).cast("double").alias("at"), F.greatest(F.lit(1.0), (F.col("y1") - F.col("y")).cast("double")).alias("height")
    )
    gap = F.greatest(F.lit(LEAST_GAP), F.col("_median") * GAP_SHARE)
    out = _lines(x, ["text", "confidence"], lambda at, y: F.abs(y - at) <= gap, lambda at, y, n: (at * n + y) / (n + 1))
    return out.withColumn("text", F.array_join(F.transform("words", lambda w: w["text"]), " "))


def print_lines(boxes: DataFrame) -> DataFrame:
    """(doc, page, line, words, text) of a text layer's boxes (doc, page, x, y, text): a line is as high as its first box."""
    x = boxes.withColumn("text", squeezed(F.replace("text", F.lit("\0"), F.lit("")))).where("text <> ''")
    x = x.select("doc", "page", "text", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("at"), F.lit(1.0).alias("height"))
    out = _lines(x, ["text"], lambda at, y: F.abs(y - at) <= TEXT_GAP, lambda at, y, n: at)
    return out.withColumn("text", F.array_join(F.transform("words", lambda w: w["text"]), " "))


# ---- scanned trades -------------------------------------------------------------------------------------

DATE = r"\d{1,2}/\d{1,2}/\d{4}"
# Owners that may stand before an asset's name, with a colon or a dash; what a scan puts before one.
OWNER_WORDS = ("spouse", "joint", "dependent child", "child")
OWNER_PREFIX = rf"(?i)^({'|'.join(OWNER_WORDS)}) ?[:-] ?"
SPECKS = "0123456789|_-–—. "


def scanned_trades(words: DataFrame, this_year: int) -> tuple[DataFrame, DataFrame]:
    """Trades (doc, page, line, owner, ticker, asset, class, side, date, amount, confidence), and (doc, page, rejected, saw_table).

    A line with a date, or with two sums, is a row. It is a trade only with a word for the side (one wrong letter at most), a
    date from 2012 to the year after this_year, sums that are a statutory range, a name, and no word of these read with
    less than 60; else it is counted as rejected. Nothing is rewritten into a near date or range.
    """
    text_of = lambda ws: F.transform(ws, lambda w: w["text"])
    x = scan_lines(words)
    x = x.withColumns({
        "_date_at": F.array_position(F.transform("words", lambda w: w["text"].rlike(DATE)), True).cast("int"),
        "_sums": F.filter("words", lambda w: w["text"].rlike(r"\$[0-9,]{3,}")),
    })
    rows = x.where("_date_at > 0 or size(_sums) >= 2")
    before = F.when(F.col("_date_at") > 0, F.slice("words", F.lit(1), F.col("_date_at") - 1)).otherwise(F.col("words"))
    rows = rows.withColumns({"_dated": F.get("words", F.col("_date_at") - 1), "_sides": F.filter(before, lambda w: type_word(w["text"]).isNotNull())})
    rows = rows.withColumn("_side", F.get("_sides", F.size("_sides") - 1))
    first, last = F.get("_sums", F.lit(0)), F.get("_sums", F.size("_sums") - 1)
    read = F.filter(F.array("_side.confidence", "_dated.confidence", first["confidence"], F.get("_sums", F.lit(1))["confidence"]), lambda c: c.isNotNull())
    edge = F.coalesce(F.col("_side.x"), F.col("_dated.x"), F.lit(float("inf")))
    name_words = F.filter("words", lambda w: (w["x"] < edge - 2) & ~F.trim(w["text"]).rlike(r"^\d{1,3}$"))
    name = F.ltrim(squeezed(F.array_join(text_of(name_words), " ")), F.lit(SPECKS))
    rows = rows.withColumns({
        "_name": F.trim(name), "date": loose_date(F.regexp_extract("_dated.text", DATE, 0)), "confidence": F.round(F.coalesce(F.array_min(read), F.lit(0)), 0).cast("int"),
        "amount": F.when(F.size("_sums") >= 2, amount_range(F.concat_ws(" - ", first["text"], last["text"]))), "_word": type_word(F.col("_side.text")),
    })
    rows = rows.withColumn("side", named(F.col("_word"), {"purchase": "buy", "sale": "sell", "exchange": "exchange"}, F.lit(None).cast("string")))
    good = F.col("side").isNotNull() & F.year("date").between(FIRST_YEAR, this_year + 1) & F.col("amount").isNotNull() & (F.length("_name") >= 3) & (F.col("confidence") >= MIN_CONFIDENCE)
    rows = rows.withColumn("_good", F.coalesce(good, F.lit(False)))
    ticker = canonical_ticker(F.regexp_extract("_name", r"\(([A-Z][A-Z0-9.]{0,8})\)", 1))
    prefix = F.regexp_extract("_name", OWNER_PREFIX, 1)
    asset = F.trim(F.regexp_replace("_name", OWNER_PREFIX, ""))
    trades = rows.where("_good").select("doc", "page", "line", F.when(prefix != "", owner(prefix)).otherwise("unknown").alias("owner"), ticker.alias("ticker"), asset.alias("asset"), asset_class(asset).alias("class"), "side", "date", "amount", "confidence")
    counts = rows.groupBy("doc", "page").agg(F.count_if(~F.col("_good")).alias("rejected"))
    pages = words.select("doc", "page").distinct().join(counts, ["doc", "page"], "left")
    return trades, pages.select("doc", "page", F.coalesce("rejected", F.lit(0)).alias("rejected"), F.col("rejected").isNotNull().alias("saw_table"))


# ---- schedules of holdings ------------------------------------------------------------------------------

# Columns of a report without a header, and how far the columns reach around the words of one.
BANDS = {"asset": (0.0, 220.0), "owner": (220.0, 270.0), "value": (270.0, 360.0)}
ASSET_LEFT, OWNER_LEFT, VALUE_LEFT, INCOME_LEFT, NO_OWNER, NO_OWNER_VALUE, NO_INCOME = 5, 8, 8, 6, 50, 15, 120
# A report with fewer letters than this is a scan.
SCAN_LETTERS = 80
OWNER_CODES = {"SP": "spouse", "JT": "joint", "DC": "dependent"}
# Classes of the official type codes.
CODE_CLASSES = {
    "stock": "ST RS", "etf_fund": "EF MF 5F", "bond": "ET AB CS GS", "crypto": "CT", "real_estate": "RP RE RF RN FA", "cash": "BA", "retirement": "4K IR IH PE DB FN VA",
    "private": "OL OI PS HE HN",
}
# Words that begin lines of headers and footers, and notes under an asset.
HEADER_WORDS = ("asset", "owner", "filing id", "name", "status", "state/district", "filing type", "filing year", "filing date", "period covered", "i certify", "s b")
NOTE_WORDS = ("l:", "d:", "l :", "d :", "* for the complete list", "*for the complete list")
VALUE_WORDS = ("none", "undetermined")
HAS_CODE, ONLY_CODES = r"\[[A-Z0-9]{2}\]", r"^(\[[A-Z0-9]{2}\] ?)+$"


def _letter(text: Column) -> Column:
    """The letter of a schedule's title, such as "S A:"; null for other texts."""
    return F.nullif(F.upper(F.regexp_extract(text, r"(?i)^s ?([a-i]) ?:", 1)), F.lit(""))


def _of_a(text: Column) -> Column:
    lower = F.lower(text)
    return lower.contains("value of asset") | lower.rlike(r"schedule ?a\b") | F.coalesce(_letter(text) == "A", F.lit(False))


def _bands(words: Column) -> Column:
    """The columns that a header's words set; null where it is none."""
    at = lambda test: F.get(F.filter(words, lambda w: test(F.lower(w["text"]))), F.lit(0))["x"]
    value, asset, own, income = at(lambda t: t.contains("value of asset")), at(lambda t: t == "asset"), at(lambda t: t == "owner"), at(lambda t: t.startswith("income type"))
    owner_from = F.coalesce(own - OWNER_LEFT, value - NO_OWNER)
    value_from = F.coalesce(F.when(own.isNotNull(), F.least(value - VALUE_LEFT, (own + value) / 2)), value - NO_OWNER_VALUE)
    value_to = F.coalesce(income - INCOME_LEFT, value + NO_INCOME)
    asset_from = F.coalesce(F.greatest(F.lit(0.0), asset - ASSET_LEFT), F.lit(0.0))
    return F.when(value.isNotNull(), F.struct(asset_from.alias("asset"), owner_from.alias("owner"), value_from.alias("value"), value_to.alias("end")))


def _between(words: Column, low: Column, high: Column) -> Column:
    return squeezed(F.array_join(F.transform(F.filter(words, lambda w: (w["x"] >= low) & (w["x"] < high)), lambda w: w["text"]), " "))


def _begins_value(text: Column) -> Column:
    lower = F.lower(text)
    return reduce_or(*(lower.startswith(w) for w in VALUE_WORDS), lower.rlike(r"^(over )?\$[0-9,]+"), lower.rlike(r"^over \$"))


def reduce_or(first: Column, *more: Column) -> Column:
    for m in more:
        first = first | m
    return first


def _written_value(text: Column) -> Column:
    """The first value that a line states, whole or cut off after its dash; empty where it states none."""
    money, dash = r"\$ ?[0-9,]+", "[-–—]"
    forms = (r"undetermined\b", r"over \$ ?50,000,000", rf"{money} ?{dash} ?\$? ?[0-9,]+", rf"{money} ?{dash}$")
    return F.trim(F.regexp_extract(text, f"(?i)({'|'.join(forms)})", 1))


def _continued(rows: Column) -> Column:
    """The holding, from 1, that each row of a report belongs to, 0 for rows of none.

    A row carries the open holding on if it holds nothing but type codes, or a name with one; if it ends the value that
    broke off; or if it is a further line of the name. Else a name with a value, an owner or a code begins a new one. The
    title of another schedule ends the open one.
    """

    def step(acc: Column, r: Column) -> Column:
        named_, valued = r["asset"] != "", r["value"] != ""
        bare_name = named_ & ~valued & r["owner"].isNull()
        has_code, begins = r["asset"].rlike(HAS_CODE), _begins_value(r["value"])
        carries = acc["open"] & ~r["ends"] & (
            r["asset"].rlike(ONLY_CODES) | (bare_name & has_code)
            | (acc["broken"] & (r["value"].rlike(r"^\$[0-9,]+$") | (~named_ & begins)))
            | (bare_name & acc["valued"] & ~_begins_value(r["asset"]))
        )
        starts = ~carries & ~r["ends"] & named_ & (begins | r["owner"].isNotNull() | has_code)
        n = acc["n"] + starts.cast("int")
        broken = F.when((carries | starts) & valued, r["value"].rlike("-$")).otherwise(~starts & ~r["ends"] & acc["broken"])
        return F.struct(
            (~r["ends"] & (acc["open"] | starts)).alias("open"), ((carries & acc["valued"]) | ((carries | starts) & valued) | (~carries & ~starts & ~r["ends"] & acc["valued"])).alias("valued"), broken.alias("broken"),
            n.alias("n"), F.concat(acc["of"], F.array(F.when(carries | starts, n).otherwise(0))).alias("of"),
        )

    no = F.lit(False)
    start = F.struct(no.alias("open"), no.alias("valued"), no.alias("broken"), F.lit(0).alias("n"), F.array().cast("array<int>").alias("of"))
    return F.aggregate(rows, start, step, lambda acc: acc["of"])


def schedule_rows(boxes: DataFrame) -> DataFrame:
    """(doc, page, line, ends, asset, owner, value, none): the lines of schedule A by column, and the titles that end it.

    The columns are those of the last header above, on this page or one before. The schedule begins with its title, its
    header, or a page that has one of them; it ends with the next title, for good if that is schedule B's.
    """
    w = Window.partitionBy("doc").orderBy("page", "line")
    upto, before = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    x = print_lines(boxes).withColumns({"_letter": _letter(F.col("text")), "_head": _bands(F.col("words")), "_a": F.exists("words", lambda v: _of_a(v["text"]))})
    x = x.withColumns({"_a": F.max("_a").over(Window.partitionBy("doc", "page")), "_bands": F.last("_head", ignorenulls=True).over(upto)})
    title = F.coalesce(F.col("_letter") == "A", F.lit(False)) | (F.col("_letter").isNull() & F.col("_head").isNotNull())
    x = x.withColumn("_saw", F.max(F.col("_a") | title).over(upto))
    other = F.col("_letter").isNotNull() & (F.col("_letter") != "A") & F.col("_saw")
    x = x.withColumn("_closed", F.coalesce(F.max(other & (F.col("_letter") == "B")).over(before), F.lit(False)))
    edge = lambda name, default: F.coalesce(F.col(f"_bands.{name}"), F.lit(default))
    a0, o0, v0, v1 = edge("asset", BANDS["asset"][0]), edge("owner", BANDS["owner"][0]), edge("value", BANDS["value"][0]), edge("end", BANDS["value"][1])
    left = F.filter("words", lambda v: v["x"] < v1)
    value, written = _between(F.col("words"), v0, v1), _written_value(squeezed(F.array_join(F.transform(left, lambda v: v["text"]), " ")))
    value = F.when((written != "") & ((value == "") | (asset_value(value)["kind"] == "unreadable")), written).otherwise(value)
    x = x.withColumns({"asset": _between(F.col("words"), a0, o0), "_own": F.upper(_between(F.col("words"), o0, v0)), "value": value})
    none = F.lower("text").isin("none disclosed", "none disclosed.") | F.lower("asset").isin("none disclosed", "none disclosed.")
    lead = F.lower(F.coalesce(F.nullif("asset", F.lit("")), F.col("text")))
    furniture = begins_with(lead, HEADER_WORDS) | F.lower("text").contains("clerk of the house") | reduce_or(*(lead.startswith(n) for n in NOTE_WORDS))
    plain = F.col("_letter").isNull() & F.col("_head").isNull() & ~F.col("_closed")
    holds = plain & ~none & ((F.col("asset") != "") | (F.col("value") != "")) & ~((F.col("asset") != "") & furniture)
    event = F.when(title, True).when(other, False).when(holds & F.col("_a") & F.col("_saw"), True)
    x = x.withColumn("_in", F.coalesce(F.last(event, ignorenulls=True).over(before), F.lit(False)))
    inside = F.col("_in") | F.col("_a")
    inner = x.where((plain & inside & (none | holds)) | (other & ~F.col("_closed")))
    return inner.select("doc", "page", "line", other.alias("ends"), "asset", named(F.col("_own"), OWNER_CODES, F.lit(None).cast("string")).alias("owner"), "value", (plain & none).alias("none"))


def schedule_holdings(boxes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Holdings (doc, nth, asset, ticker, class, code, owner, bound, low, high, mid, label) of annual reports' boxes (doc, page, x, y, text),
    and (doc, status, none_disclosed, holdings, excluded, unreadable).

    Assets whose value is none or not disclosed are counted as excluded, those whose value is no statutory range as
    unreadable; neither is guessed. Reports without the schedule wait for a scan's reading where they hold hardly any letters.
    """
    rows = kept(schedule_rows(boxes), "schedule")
    docs = rows.where("not none").groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("page", "line", "ends", "asset", "owner", "value"))).alias("rows"))
    parts = docs.select("doc", F.posexplode(F.arrays_zip(_continued(F.col("rows")).alias("nth"), F.col("rows").alias("r"))).alias("at", "v")).where("v.nth > 0")
    in_order = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("at", c.alias("c")))), lambda s: s["c"])
    joined = lambda c: squeezed(F.array_join(F.filter(in_order(F.col(c)), lambda s: s != ""), " "))
    x = parts.groupBy("doc", F.col("v.nth").alias("nth")).agg(joined("v.r.asset").alias("asset"), joined("v.r.value").alias("written"), F.min_by("v.r.owner", F.when(F.col("v.r.owner").isNotNull(), F.col("at"))).alias("owner"))
    asset = squeezed(F.replace("asset", F.lit("⇒"), F.lit(" ")))
    tail = F.regexp_extract(asset, r"(?i) (SP|JT|DC)$", 1)
    from_tail = F.col("owner").isNull() & (tail != "")
    asset = F.when(from_tail, F.left(asset, F.length(asset) - 3)).otherwise(asset)
    x = x.withColumns({"owner": F.coalesce("owner", named(F.upper(tail), OWNER_CODES, F.lit("self"))), "asset": F.trim(F.regexp_replace(asset, r"(?i) ?\* ?Investment Vehicle details available\b.*", ""))})
    x = x.withColumn("v", F.when(F.col("asset") != "", asset_value(F.col("written"))))
    codes = F.regexp_extract_all("asset", F.lit(r"\[([A-Z0-9]{2})\]"), F.lit(1))
    code = F.get(codes, F.size(codes) - 1)
    by_code = named(code, {c: k for k, cs in CODE_CLASSES.items() for c in cs.split()}, F.when(code.isNotNull(), "other"))
    tickers = F.filter(F.transform(F.regexp_extract_all("asset", F.lit(r"\(([A-Z][A-Z0-9.]{0,8})\)"), F.lit(1)), canonical_ticker), lambda s: s.isNotNull())
    bare = squeezed(F.regexp_replace("asset", HAS_CODE, " "))
    good = F.coalesce(F.col("v.kind").isin("range", "at_least", "undetermined"), F.lit(False))
    excluded = F.coalesce(F.col("v.kind") == "excluded", F.lit(False))
    holdings = x.where(good).select(
        "doc", "nth", F.coalesce(F.nullif(bare, F.lit("")), F.col("asset")).alias("asset"), F.get(tickers, F.size(tickers) - 1).alias("ticker"), F.coalesce(by_code, asset_class(bare)).alias("class"), code.alias("code"), "owner",
        F.col("v.kind").alias("bound"), F.col("v.low").alias("low"), F.col("v.high").alias("high"), F.col("v.mid").alias("mid"), F.col("v.label").alias("label"),
    )
    counts = x.groupBy("doc").agg(F.count_if(good).alias("holdings"), F.count_if(excluded).alias("excluded"), F.count_if(~good & ~excluded).alias("unreadable"))
    none = rows.groupBy("doc").agg(F.max("none").alias("none_disclosed"))
    every = boxes.groupBy("doc").agg(F.sum(F.length(F.regexp_replace("text", "[^A-Za-z]", ""))).alias("_letters"), F.max(_of_a(squeezed(F.col("text")))).alias("_saw"))
    titled = print_lines(boxes).where(F.coalesce(_letter(F.col("text")) == "A", F.lit(False))).select("doc", F.lit(True).alias("_titled")).distinct()
    out = every.join(titled, "doc", "left").join(none, "doc", "left").join(counts, "doc", "left")
    n = lambda c: F.coalesce(c, F.lit(0))
    status = (
        F.when(~(F.col("_saw") | F.coalesce("_titled", F.lit(False))), F.when(n("_letters") < SCAN_LETTERS, "pending_ocr").otherwise("needs_manual_review"))
        .when((n("holdings") == 0) & (n("unreadable") > 0) & (n("excluded") == 0), "needs_manual_review").when(n("unreadable") > 0, "partial").otherwise("parsed")
    )
    return holdings, out.select("doc", status.alias("status"), F.coalesce("none_disclosed", F.lit(False)).alias("none_disclosed"), n("holdings").alias("holdings"), n("excluded").alias("excluded"), n("unreadable").alias("unreadable"))


# ---- assets by part -------------------------------------------------------------------------------------

# Whose assets each part lists, how far its columns reach beside the header's words, and rows that are none.
PART_OWNERS = {"2": "self", "5": "spouse", "6": "unknown"}
DESCRIPTION_LEFT, COLUMN_RIGHT, NO_INCOME_TYPE = 4, 2, 140
PART_FURNITURE = ("instructions for part", "filer's name", "filers name", "oge form", "note:", "page number", "#", "description")


def _part_bands(words: Column) -> Column:
    at = lambda test: F.get(F.filter(words, lambda w: test(F.lower(w["text"]))), F.lit(0))["x"]
    name, eif, value, income = at(lambda t: t == "description"), at(lambda t: t == "eif"), at(lambda t: t == "value"), at(lambda t: t.contains("income type"))
    bands = F.struct(
        (name - DESCRIPTION_LEFT).alias("name"), (F.coalesce(eif, value) - COLUMN_RIGHT).alias("name_end"), (value - DESCRIPTION_LEFT).alias("value"), (F.coalesce(income, value + NO_INCOME_TYPE) - COLUMN_RIGHT).alias("end")
    )
    return F.when(name.isNotNull() & value.isNotNull(), bands)


def _continued_parts(rows: Column) -> Column:
    """As _continued: a description with a value begins a holding, one without carries it on, and so does a value after a dash."""

    def step(acc: Column, r: Column) -> Column:
        named_, valued = r["asset"] != "", r["value"] != ""
        starts = ~r["ends"] & named_ & F.lower(r["value"]).rlike(r"^(none|over\s+\$|\$[0-9,]+)")
        carries = ~r["ends"] & ~starts & acc["open"] & ((named_ & ~valued) | (valued & acc["broken"]))
        n = acc["n"] + starts.cast("int")
        broken = F.when((starts | carries) & valued, r["value"].rlike("-$")).otherwise(~r["ends"] & acc["broken"])
        return F.struct((~r["ends"] & (acc["open"] | starts)).alias("open"), broken.alias("broken"), n.alias("n"), F.concat(acc["of"], F.array(F.when(starts | carries, n).otherwise(0))).alias("of"))

    start = F.struct(F.lit(False).alias("open"), F.lit(False).alias("broken"), F.lit(0).alias("n"), F.array().cast("array<int>").alias("of"))
    return F.aggregate(rows, start, step, lambda acc: acc["of"])


def part_holdings(boxes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Holdings (doc, nth, asset, ticker, class, owner, bound, low, high, mid, label) of executive annual reports' boxes, and (doc, status,
    report_year, holdings, excluded, unreadable).

    A title of part 2, 5 or 6 sets the owner, and a header the columns, each up to the end of its page. Titles end the open
    holding; other pages' rows carry it on. Values that are no range, and names without a word, are unreadable.
    """
    w = Window.partitionBy("doc", "page").orderBy("line")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    x = print_lines(boxes).withColumns({"_head": _part_bands(F.col("words")), "_part": F.regexp_extract("text", r"(?i)part\s*([256])\s*:", 1)})
    who = named(F.col("_part"), PART_OWNERS, F.lit(None).cast("string"))
    x = x.withColumn("_who", who).withColumns({"owner": F.last("_who", ignorenulls=True).over(upto), "_bands": F.last("_head", ignorenulls=True).over(upto)})
    asset, value = _between(F.col("words"), F.col("_bands.name"), F.col("_bands.name_end")), _between(F.col("words"), F.col("_bands.value"), F.col("_bands.end"))
    ends = F.col("_who").isNotNull()
    reads = F.col("_bands").isNotNull() & F.col("_head").isNull() & F.col("owner").isNotNull()
    x = x.withColumns({"asset": F.when(reads, asset).otherwise(""), "value": F.when(reads, value).otherwise(""), "ends": ends})
    x = x.where(ends | (reads & ((F.col("asset") != "") | (F.col("value") != "")) & ~F.lower("asset").isin(*PART_FURNITURE)))
    # A title's line may hold a row too: the end comes first.
    each = F.when(F.col("ends"), F.array(F.struct(F.lit(0).alias("k"), F.lit(True).alias("ends"), F.lit("").alias("asset"), F.lit("").alias("value")))).otherwise(F.array().cast("array<struct<k:int,ends:boolean,asset:string,value:string>>"))
    row = F.array(F.struct(F.lit(1).alias("k"), F.lit(False).alias("ends"), "asset", "value"))
    x = x.select("doc", "page", "line", "owner", F.explode(F.concat(each, row)).alias("r")).select("doc", "page", "line", "r.k", "r.ends", "r.asset", "r.value", "owner")
    docs = x.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("page", "line", "k", "ends", "asset", "value", "owner"))).alias("rows"))
    parts = docs.select("doc", F.posexplode(F.arrays_zip(_continued_parts(F.col("rows")).alias("nth"), F.col("rows").alias("r"))).alias("at", "v")).where("v.nth > 0")
    joined = lambda c: squeezed(F.array_join(F.filter(F.transform(F.array_sort(F.collect_list(F.struct("at", F.col(c).alias("c")))), lambda s: s["c"]), lambda s: s != ""), " "))
    y = parts.groupBy("doc", F.col("v.nth").alias("nth")).agg(joined("v.r.asset").alias("asset"), joined("v.r.value").alias("written"), F.min_by("v.r.owner", "at").alias("owner"))
    y = y.withColumn("asset", F.trim(F.regexp_replace("asset", r"\s+\*+$", ""))).withColumn("v", F.when(F.col("asset").rlike("[A-Za-z]{3,}"), asset_value(F.col("written"))))
    tickers = F.filter(F.transform(F.regexp_extract_all("asset", F.lit(r"\(([A-Z][A-Z0-9.]{0,8})\)"), F.lit(1)), canonical_ticker), lambda s: s.isNotNull())
    good, excluded = F.coalesce(F.col("v.kind").isin("range", "at_least"), F.lit(False)), F.coalesce(F.col("v.kind") == "excluded", F.lit(False))
    holdings = y.where(good).select("doc", "nth", "asset", F.get(tickers, F.size(tickers) - 1).alias("ticker"), asset_class(F.col("asset")).alias("class"), "owner", F.col("v.kind").alias("bound"), "v.low", "v.high", "v.mid", "v.label")
    counts = y.groupBy("doc").agg(F.count_if(good).alias("holdings"), F.count_if(excluded).alias("excluded"), F.count_if(~good & ~excluded).alias("unreadable"))
    year = F.nullif(F.regexp_extract("text", r"(?i)year\s*\(annual\b[^0-9]{0,40}(20\d\d)", 1), F.lit("")).cast("int")
    saw = print_lines(boxes).groupBy("doc").agg(F.bool_or(F.col("text").rlike(r"(?i)part\s*[256]\s*:")).alias("_saw"), F.min_by(year, F.when(year.isNotNull(), F.struct("page", "line"))).alias("report_year"))
    letters = boxes.groupBy("doc").agg(F.sum(F.length(F.regexp_replace("text", "[^A-Za-z]", ""))).alias("_letters"))
    out = letters.join(saw, "doc", "left").join(counts, "doc", "left")
    n, sees = (lambda c: F.coalesce(c, F.lit(0))), F.coalesce("_saw", F.lit(False))
    status = (
        F.when(~sees & (n("_letters") < SCAN_LETTERS), "pending_ocr").when(~sees | ((n("holdings") == 0) & (n("excluded") == 0)), "needs_manual_review").when(n("unreadable") > 0, "partial").otherwise("parsed")
    )
    return holdings, out.select("doc", status.alias("status"), "report_year", *(n(c).alias(c) for c in ("holdings", "excluded", "unreadable")))
