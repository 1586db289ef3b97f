"""Entity resolution: asset names to tickers in stages, each an equi-join on the stem of a name.

The catalog and the lists beside it (curated funds, listings of share classes, aliases) are tables that the caller gives.
What several stages read (the catalog's index, the forms of names, exact hits) is written once to the shared folder.
Names are resolved by different text, so copies cost nothing; close spellings are found by what they have in common less an edit, or by pieces.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.assets import asset_name, described_class, is_preferred, never_matched
from ..functions.labels import split_suffix
from ..functions.text import canonical_ticker, similarity
from ..sources.kept import kept, spread

LEAST, GAP = 0.94, 0.04
# The shortest stem that is compared by spelling, and the shortest that it is compared with.
SHORTEST, SHORTEST_LISTED = 12, 8
#: Listed names that may have a piece in common before it stands for nothing.
HEAVY = 64
# Last letters of tickers of shares that are not issued yet, and of those that are no class of common shares.
WHEN_ISSUED, NOT_COMMON = "MNVWZ", "DEFHIJLQRSTUVWYZ"
NO_LIST = "select cast(null as string) name, cast(null as string) ticker, cast(null as string) class, cast(null as string) share_class where false"


def exchange_tier(exchange: Column) -> Column:
    """1 for the large exchanges, 2 for others, 3 over the counter."""
    e = F.lower(F.trim(F.coalesce(exchange, F.lit(""))))
    return F.when(e == "otc", 3).when(e.contains("nasdaq") | e.contains("nyse") | e.isin("cboe", "txse"), 1).otherwise(2)


def _without_tails(tickers: Column, letters: str, keep: Column | None = None) -> Column:
    """Tickers but those that are another one and one of the letters."""
    shorter = lambda t: F.left(t, F.length(t) - 1)
    tail = lambda t: (F.length(t) > 1) & F.right(t, F.lit(1)).isin(*letters) & F.array_contains(tickers, shorter(t))
    return F.filter(tickers, lambda t: ~tail(t) if keep is None else (F.array_contains(keep, t) | ~tail(t)))


def _sorted_join(left: DataFrame, right: DataFrame, on: str | list[str], how: str = "inner") -> DataFrame:
    """A join of tables that both grow with the names, never by a broadcast: of a written table Spark guesses a few columns' size
    from its compressed files, a twentieth of what the driver would then hold.
    """
    return left.join(right.hint("merge"), on, how)


def _stemmed(rows: DataFrame, *more: str) -> DataFrame:
    x = rows.select(asset_name(F.col("name")).alias("n"), canonical_ticker(F.col("ticker")).alias("ticker"), *more)
    # Written, as a condition on the stem would be worked out beside it.
    return kept(x.select("n.*", "ticker", *more), "stems").where("ticker is not null")


def class_listings(listings: DataFrame) -> DataFrame:
    """(stem, share_class, ticker) of (name, share_class, ticker): tickers whose class letter is not at their end."""
    x = listings.select(asset_name(F.col("name"))["stem"].alias("stem"), F.lower("share_class").alias("share_class"), canonical_ticker(F.col("ticker")).alias("ticker"))
    return x.where("ticker is not null and stem <> ''").groupBy("stem", "share_class").agg(F.max("ticker").alias("ticker"))


def catalog_index(catalog: DataFrame, listings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(stem, share_class, ticker, class), and all of a stem in a row, of a catalog (name, ticker, exchange) and class_listings."""
    return _index_of(_catalog_stems(catalog), listings)


def _catalog_stems(catalog: DataFrame) -> DataFrame:
    return _stemmed(catalog.select("name", "ticker", exchange_tier(F.col("exchange")).alias("tier")), "tier")


def _index_of(rows: DataFrame, listings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(stem, share_class, ticker, class), and (stem, class, known, classed, mapped, one, whole, by_class) of a catalog's stems: tickers by
    class where there is one, that of the stem, and what listings say of its classes.

    Of a stem's tickers only those of its best tier of exchanges count. Of its tickers without a class letter, those that are
    another one and a letter for when-issued or for no common shares go, unless a listing of classes names them; then it
    has a ticker if just one is left. So has each class with just one, and, where there is no other, the stem through it.
    """
    x = rows.where("length(stem) > 1").withColumn("best", F.min("tier").over(Window.partitionBy("stem"))).where("tier = best")
    letter = F.lower(F.regexp_extract("ticker", r"\.([A-Z])$", 1))
    kind = F.when(F.col("etf"), 2).when(F.col("fund"), 1).otherwise(0)
    x = x.groupBy("stem", letter.alias("share_class")).agg(F.collect_set("ticker").alias("tickers"), F.max(kind).alias("kind"))
    mapped = listings.groupBy("stem").agg(F.collect_set("ticker").alias("protect"), F.collect_list(F.struct("share_class", "ticker")).alias("by_class"))
    by_stem = x.groupBy("stem").agg(
        F.max("kind").alias("kind"), F.flatten(F.collect_list("tickers")).alias("known"), F.flatten(F.collect_list(F.when(F.col("share_class") == "", F.col("tickers")))).alias("plain"),
        F.collect_list(F.when(F.col("share_class") != "", F.struct("share_class", "tickers"))).alias("classes"),
    )
    by_stem = _sorted_join(by_stem, mapped, "stem", "left")
    protect = F.coalesce("protect", F.array().cast("array<string>"))
    one = F.filter("classes", lambda c: F.size(c["tickers"]) == 1)
    by_stem = by_stem.withColumn("plain", _without_tails(F.col("plain"), WHEN_ISSUED)).withColumn("plain", _without_tails(F.col("plain"), NOT_COMMON, protect))
    by_stem = by_stem.withColumns({"one": one, "mapped": F.coalesce(F.arrays_overlap("known", protect), F.lit(False)), "class": F.element_at(F.array(F.lit("stock"), F.lit("fund"), F.lit("etf")), F.col("kind") + 1)})
    whole = F.when(F.size("plain") == 1, F.get("plain", F.lit(0))).when((F.size("plain") == 0) & (F.size("classes") == 1) & (F.size("one") == 1), F.get("one", F.lit(0))["tickers"][0])
    by_stem = by_stem.withColumns({"whole": whole, "classed": F.size("one") > 0, "one": F.transform("one", lambda c: F.struct(c["share_class"].alias("share_class"), c["tickers"][0].alias("ticker")))})
    by_stem = kept(by_stem.select("stem", "class", "known", "classed", "mapped", "one", "whole", "by_class"), "catalog")
    entries = F.concat("one", F.array(F.struct(F.lit("").alias("share_class"), F.col("whole").alias("ticker"))))
    index = by_stem.select("stem", "class", F.explode(entries).alias("e")).select("stem", "e.share_class", "e.ticker", "class").where("ticker is not null")
    return index, by_stem


def unambiguous(rows: DataFrame, *more: str) -> DataFrame:
    """(stem, ticker, more) of named rows: a stem with two tickers has a null one."""
    x = _stemmed(rows.select("name", "ticker", *more), *more).where("stem <> ''").groupBy("stem")
    return x.agg(F.when(F.countDistinct("ticker") == 1, F.min("ticker")).alias("ticker"), *(F.min(m).alias(m) for m in more))


def _edits(m: Column, least: float) -> Column:
    """The most edits that a name alike by least to one of m letters can have."""
    return F.floor((1 - least) * m / least + 1e-9).cast("int")


def one_edit_apart(stems: DataFrame, others: DataFrame, least: float) -> DataFrame:
    """(stem, head, other, ticker): all pairs of one head that are equal or one edit apart, of others that allow no more.

    An equi-join on whole names, on those less a letter, and on a place and the name less the letter there: however long a part
    all names share, it pairs only names that are that near.
    """
    shorter = lambda s, tag: F.transform(F.sequence(F.lit(1), F.length(s)), lambda i: F.concat(tag(i), F.substring(s, F.lit(1), i - 1), F.substring(s, i + 1, F.length(s))))
    whole, less, place = (lambda _: F.lit("w:")), (lambda _: F.lit("d:")), (lambda i: F.concat(i.cast("string"), F.lit(":")))
    key = lambda *arrays: F.explode(F.array_distinct(F.concat(*arrays))).alias("key")
    n, s, o = F.length("stem"), F.col("stem"), F.col("other")
    left = stems.where(_edits(F.ceil(n * least - 1e-9), least) <= 1).select("stem", "head", key(F.array(F.concat(F.lit("w:"), s)), shorter(s, less), shorter(s, place)))
    right = others.where(_edits(F.length("other"), least) <= 1).select("head", "other", "ticker", key(F.array(F.concat(F.lit("w:"), o), F.concat(F.lit("d:"), o)), shorter(o, whole), shorter(o, place)))
    return _sorted_join(left, right, ["head", "key"]).select("stem", "head", "other", "ticker").distinct()


def shared_pieces(stems: DataFrame, others: DataFrame, least: float) -> DataFrame:
    """(stem, head, other, ticker): all pairs of one head that can be alike by least, and few that cannot.

    A stem of m letters allows k = (1 - least) m / least edits at most. Of k + 1 pieces that it is cut into, one is
    untouched, and lies in the like stem at most k places away: an equi-join by length, piece and its letters finds it.
    What has a piece that over HEAVY others have is found by :func:`one_edit_apart` instead, where one edit is all that is allowed.
    """
    edits = lambda m: _edits(m, least)
    start = lambda i, m: F.floor(i * m / (edits(m) + 1)).cast("int")
    m, i = F.col("m"), F.col("i")
    size = start(i + 1, m) - start(i, m)
    right = others.withColumn("m", F.length("other")).withColumn("i", F.explode(F.sequence(F.lit(0), edits(m))))
    right = right.select("head", "m", "i", "other", "ticker", F.substring("other", start(i, m) + 1, size).alias("piece"))
    n = F.length("stem")
    left = stems.select("stem", "head", F.explode(F.sequence(F.ceil(n * least - 1e-9).cast("int"), F.floor(n / least + 1e-9).cast("int"))).alias("m"))
    left = left.withColumn("i", F.explode(F.sequence(F.lit(0), edits(m))))
    at = F.filter(F.transform(F.sequence(-edits(m), edits(m)), lambda d: start(i, m) + d), lambda a: (a >= 0) & (a + size <= n))
    left = left.select("stem", "head", "m", "i", F.explode(F.array_distinct(F.transform(at, lambda a: F.substring("stem", a + 1, size)))).alias("piece"))
    keys = ["head", "m", "i", "piece"]
    heavy = kept(right.where(edits(m) <= 1).groupBy(*keys).count().where(F.col("count") > HEAVY).select(*keys), "heavy")
    near = one_edit_apart(*(_sorted_join(x, heavy, keys, "left_semi").select(*c).distinct() for x, c in ((left, ["stem", "head"]), (right, ["head", "other", "ticker"]))), least)
    found = _sorted_join(left, _sorted_join(right, heavy, keys, "left_anti"), keys).select("stem", "head", "other", "ticker")
    return found.unionByName(near).distinct()


def close_names(stems: DataFrame, listed: DataFrame, least: float = LEAST, gap: float = GAP) -> DataFrame:
    """(stem, share_class, ticker, class, score): for each (stem, share_class) the listed (stem, share_class, ticker, class) of that class that is
    spelled most like it, if it reaches least and no other ticker comes within gap. First letters agree, and first words of four letters or more.
    """
    # A long first word has to agree as it is, so it is part of what is joined: words at a name's end that all share pair nothing by themselves.
    first = F.substring_index("stem", " ", 1)
    by_letter, by_word = F.concat_ws("|", "share_class", F.left("stem", F.lit(1))), F.concat_ws("|", "share_class", first, F.lit(""))
    others = listed.where(F.length("stem") >= SHORTEST_LISTED).select(F.col("stem").alias("other"), F.explode(F.array(by_letter, F.when(F.length(first) >= 4, by_word))).alias("head"), F.struct("ticker", "class").alias("ticker")).where("head is not null")
    cand = shared_pieces(stems.where(F.length("stem") >= SHORTEST).select("stem", F.when(F.length(first) >= 4, by_word).otherwise(by_letter).alias("head")), others, least)
    cand = cand.where((F.length(first) < 4) | (F.substring_index("other", " ", 1) == first)).withColumn("score", similarity(F.col("stem"), F.col("other"))).where(F.col("score") >= least)
    best = cand.groupBy("stem", "head", "ticker.ticker").agg(F.max(F.struct("score", "ticker.class")).alias("s"))
    w = Window.partitionBy("stem", "head").orderBy(F.desc("s.score"), "ticker")
    best = best.withColumns({"k": F.row_number().over(w), "runner": F.lead("s.score").over(w)}).where("k = 1")
    best = best.where(F.col("runner").isNull() | (F.round(F.col("s.score") - F.col("runner"), 9) > gap))
    return best.select("stem", F.substring_index("head", "|", 1).alias("share_class"), "ticker", "s.class", "s.score")


def forms_of(asset: Column) -> Column:
    """(nth, form, name): the name as written, and others that it may stand for: its suffix set apart, without a mark for
    foreign shares, without a mark for a real estate trust.
    """
    text = F.coalesce(asset, F.lit(""))
    other = (("repaired", split_suffix(text)), ("foreign", F.regexp_replace(text, r"(?i)\s+F$", "")), ("reit", F.regexp_replace(F.regexp_replace(text, r"(?i)(?:\s+REIT)+$", ""), r"(?i)\s+RE\s+IT$", "")))
    form = lambda n, name, c: F.struct(F.lit(n).alias("nth"), F.lit(name).alias("form"), c.alias("name"))
    made = F.array(form(0, "written", text), *(F.when(c != text, form(n, name, c)) for n, (name, c) in enumerate(other, 1)))
    return F.filter(made, lambda f: f.isNotNull())


def match_names(
    names: DataFrame, catalog: DataFrame, curated: DataFrame | None = None, listings: DataFrame | None = None, aliases: DataFrame | None = None, least: float = LEAST, gap: float = GAP
) -> DataFrame:
    """(id, ticker, class, stage, form, confidence) of names (id, name), by the first stage that decides:

    blocked (debt, option, crypto, private, preferred: never a ticker); as written: curated, exact by stem and class, then
    fuzzy; another form, curated or exact; an alias. A preferred or numbered series of a name with an alias is "preferred",
    without a ticker, even where a stage before found one. Else the stage is none.

    catalog: (name, ticker, exchange); curated: (name, ticker, class); listings: (name, share_class, ticker); aliases: (name, ticker).
    """
    spark = names.sparkSession
    none = spark.sql(NO_LIST)
    classes = class_listings(listings if listings is not None else none)
    rows = _catalog_stems(catalog)
    index, stems = _index_of(rows, classes)
    funds = unambiguous(curated if curated is not None else none, "class")
    alias = unambiguous(aliases if aliases is not None else none)
    alias = _sorted_join(alias, rows.select("ticker", F.lit(True).alias("is_real")).distinct(), "ticker", "left")

    # Few bytes and dear work: after the shuffle of distinct the names would lie in a task or two.
    texts = spread(names.select(F.coalesce("name", F.lit("")).alias("asset")).distinct())
    forms = texts.select("asset", F.explode(forms_of(F.col("asset"))).alias("f")).select("asset", "f.nth", "f.form", "f.name")
    forms = forms.withColumns({"n": asset_name(F.col("name")), "blocked": never_matched(F.col("name"))}).select("asset", "nth", "form", "n.*", "blocked", described_class(F.col("name")).alias("described"))
    forms = kept(forms, "forms")

    # Exact stages: equi-joins on the stem with all that is known of it.
    x = _sorted_join(forms.where("blocked is null"), stems, "stem", "left")
    x = _sorted_join(x, funds.where("ticker is not null").select("stem", F.struct("ticker", F.col("class").alias("class")).alias("fund_hit")), "stem", "left")
    of_class = lambda entries: F.get(F.filter(entries, lambda e: e["share_class"] == F.col("share_class")), F.lit(0))["ticker"]
    hit_of = lambda ticker, kind: F.when(ticker.isNotNull(), F.struct(ticker.alias("ticker"), kind.alias("class")))
    by_map = F.when(F.array_contains("known", of_class(F.col("by_class"))), of_class(F.col("by_class")))
    single = F.when((F.col("share_class") == "") | ~(F.coalesce("classed", F.lit(False)) | F.coalesce("mapped", F.lit(False))), F.col("whole"))
    exact = F.coalesce(hit_of(of_class(F.col("one")), F.col("class")), hit_of(by_map, F.lit("stock")), hit_of(single, F.col("class")))
    own = lambda found: F.when(F.col("etf"), "etf").when(F.col("fund"), "fund").otherwise(found)
    x = x.withColumn("e", exact).where("fund_hit is not null or e is not null")
    fund_class = F.coalesce("fund_hit.class", F.when(F.col("etf"), "etf").otherwise("fund"))
    hit = F.when(F.col("fund_hit").isNotNull(), F.struct(F.col("fund_hit.ticker").alias("ticker"), fund_class.alias("class"), F.lit("curated").alias("stage"), "form", F.lit(100).alias("confidence")))
    hit = hit.otherwise(F.struct(F.col("e.ticker").alias("ticker"), own(F.col("e.class")).alias("class"), F.lit("exact").alias("stage"), "form", F.lit(100).alias("confidence")))
    found = kept(x.groupBy("asset").agg(F.min_by(hit, "nth").alias("hit"), F.min("nth").alias("nth")), "found")

    # As written: what is blocked, the alias that its stem begins with, and what is spelled like it where no exact one was found.
    unfound = _sorted_join(forms.where("nth = 0 and blocked is null"), found.where("nth = 0").select("asset"), "asset", "left_anti")
    more = _sorted_join(funds.where("ticker is not null"), stems.where("whole is not null").select("stem"), "stem", "left_anti")
    listed = index.unionByName(more.select("stem", F.lit("").alias("share_class"), "ticker", "class"))
    close = close_names(unfound.select("stem", "share_class").distinct(), listed, least, gap).select("stem", "share_class", F.struct("ticker", "class", "score").alias("close"))
    words = F.split("stem", " ")
    prefixes = forms.where("nth = 0 and stem <> ''").select("stem").distinct().select(F.col("stem").alias("of"), F.explode(F.transform(F.sequence(F.lit(1), F.size(words)), lambda k: F.array_join(F.slice(words, F.lit(1), k), " "))).alias("stem"))
    keys = _sorted_join(prefixes, alias.withColumnRenamed("ticker", "alias"), "stem").where(F.col("alias").isNotNull() | (F.col("stem") == F.col("of")))
    keys = keys.groupBy(F.col("of").alias("stem")).agg(F.max_by(F.struct(F.col("stem").alias("key"), F.col("alias").alias("ticker"), "is_real"), F.length("stem")).alias("key"))

    y = _sorted_join(_sorted_join(forms.where("nth = 0").drop("nth", "form"), close, ["stem", "share_class"], "left"), keys, "stem", "left")
    y = _sorted_join(y, found, "asset", "left")
    series = is_preferred(F.col("asset")) | F.col("asset").rlike(r"(?i)\bseries\b")
    result = lambda ticker, kind, stage, form, conf: F.struct(ticker.cast("string").alias("ticker"), kind.alias("class"), stage.alias("stage"), form.cast("string").alias("form"), conf.cast("int").alias("confidence"))
    null, lit = F.lit(None), F.lit
    fuzzy = F.when(F.col("close").isNotNull(), result(F.col("close.ticker"), own(F.col("close.class")), lit("fuzzy"), lit("written"), F.round(F.col("close.score") * 100)))
    ready = F.when(F.col("hit").isNotNull(), result(F.col("hit.ticker"), F.col("hit.class"), F.col("hit.stage"), F.col("hit.form"), F.col("hit.confidence")))
    ranked = F.coalesce(F.when(F.col("nth") == 0, ready), fuzzy, ready)
    blocked_class = named_class(F.col("blocked"))
    preferred = result(null, lit("other"), lit("preferred"), null, null)
    usable = F.col("key.ticker").isNotNull() & F.coalesce("key.is_real", lit(False))
    by_alias = F.when(usable & series, preferred).when(usable & (F.col("key.key") == F.col("stem")), result(F.col("key.ticker"), lit("stock"), lit("alias"), lit("written"), lit(100)))
    final = (
        F.when(F.col("blocked").isNotNull(), result(null, blocked_class, F.col("blocked"), null, null)).when(ranked.isNotNull() & series & F.col("key").isNotNull(), preferred)
        .otherwise(F.coalesce(ranked, by_alias, result(null, F.col("described"), lit("none"), null, null)))
    )
    return _sorted_join(names.select("id", F.coalesce("name", F.lit("")).alias("asset")), y.select("asset", final.alias("r")), "asset").select("id", "r.*")


def named_class(reason: Column) -> Column:
    """The class of what is never matched."""
    return F.when(reason == "debt", "bond").when(reason.isin("option", "crypto"), reason).otherwise("other")
