"""Quality rules: a threshold table compiled into one Spark projection, without user functions.

Every rule is a row of :data:`RULES`: a metric, an inclusive lower and upper bound (None: open) and the
least number of words from which the rule is asked at all (ratios over a handful of words say nothing).
:func:`measure` computes all metrics of a table; :func:`verdict` folds the rule table into one boolean.

Defined results: a null text counts as empty (0 words, all counts 0, ratios 0); repeated rows and equal ids
are judged each on their own; extra columns are kept by :func:`apply_rules`, and metric columns of the same
name are replaced. Texts are never cut.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, text_of, words_of

SYMBOLS = "#*$%&|<>"
WINDOW = 5
#: Bits for a word's place: texts of up to 268 million words, more than a Spark string holds.
PLACE_BITS = 28

# Frequent function words by language.
STOP_WORDS = {
    "en": "the of and to in a is that for it as was with be by on not he his but at are this have from or had an they which one you were all her she there would their we him been has when who will no more if out so said what up its about than into them can only other".split(),
    "fr": "de la le et les des en un du une que est pour qui dans par plus pas au sur ne se ce il sont avec ou son ses mais comme on nous vous elle leur".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um".split(),
    "es": "de la que el en y a los del se las por un para con no una su al lo como más o pero sus le ya este sí porque esta entre".split(),
}


@dataclass(frozen=True)
class Rule:
    name: str
    metric: str
    low: float | None
    high: float | None
    from_words: int = 0


RULES = (
    Rule("enough words", "n_words", 10, None),
    Rule("word length, least", "mean_word_chars", 2.0, None, 20),
    Rule("word length, most", "mean_word_chars", None, 14.0, 20),
    Rule("symbols per word", "symbol_ratio", None, 0.1),
    Rule("capitals per character", "upper_ratio", None, 0.4, 10),
    Rule("exclamations per word", "exclaim_ratio", None, 0.25, 10),
    Rule("stop words", "stop_ratio", 0.02, None, 60),
    Rule("repeated lines", "dup_line_ratio", None, 0.5),
    Rule("bullet lines", "bullet_line_ratio", None, 0.9, 10),
    Rule("lines that trail off", "ellipsis_line_ratio", None, 0.3, 10),
)


#: Columns that measure and apply_rules add.
METRICS = (
    "n_words word_chars n_symbols n_dup_lines n_lines n_stop_words n_different_words n_exclaims n_upper n_bullet_lines n_ellipsis_lines n_repeat_words "
    "mean_word_chars symbol_ratio upper_ratio exclaim_ratio stop_ratio dup_line_ratio bullet_line_ratio ellipsis_line_ratio repeat_ratio base_failed kept"
).split()


def stop_word_list() -> list[str]:
    """All stop words, also with a capital initial."""
    words = {w for ws in STOP_WORDS.values() for w in ws}
    return sorted(words | {w[0].upper() + w[1:] for w in words})


def count_chars(text: Column, chars: str) -> Column:
    return F.length(F.regexp_replace(text, f"[^{chars}]+", ""))


def repeat_words(docs: DataFrame, words: str, out: str) -> DataFrame:
    """Adds the number of words inside WINDOW-word windows that occur twice or more in the text.

    Windows are compared by 64-bit hashes. A text without equal hashes, nearly every one, is done after one
    hash set; only the others sort their windows.
    """
    last = F.size(words) - WINDOW
    grams = F.when(
        last >= 0,
        F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(WINDOW)])),
    )
    docs = docs.withColumn("_grams", grams)
    found = F.size(F.array_distinct("_grams")) < F.size("_grams")
    # The upper bits of a hash and the place in one number, as numbers sort faster than pairs.
    packed = F.transform("_grams", lambda h, i: h.bitwiseAND(F.lit(-1 << PLACE_BITS)).bitwiseOR(i.cast("long")))
    docs = docs.withColumn("_ordered", F.when(found, F.sort_array(packed)))

    def place(x: Column) -> Column:
        return x.bitwiseAND(F.lit((1 << PLACE_BITS) - 1)).cast("int")

    def same(x: Column, j: Column) -> Column:
        y = F.get("_ordered", j)
        near = F.shiftright(x, PLACE_BITS) == F.shiftright(y, PLACE_BITS)
        return F.coalesce(near & (F.get("_grams", place(x)) == F.get("_grams", place(y))), F.lit(False))

    places = F.sort_array(F.transform(F.filter("_ordered", lambda x, j: same(x, j - 1) | same(x, j + 1)), place))
    covered = F.aggregate(
        places,
        F.struct(F.lit(-WINDOW).alias("at"), F.lit(0).cast("long").alias("n")),
        lambda acc, p: F.struct(p.alias("at"), (acc["n"] + F.least(F.lit(WINDOW), p - acc["at"])).alias("n")),
        lambda acc: acc["n"],
    )
    return docs.withColumn(out, F.when(F.col("_ordered").isNull(), F.lit(0).cast("long")).otherwise(covered)).drop("_grams", "_ordered")


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds every metric that a rule may name (in place of columns of the same names)."""
    docs = docs.drop(*METRICS)
    docs = docs.withColumn("_text", text_of(text)).withColumn("_words", words_of(F.col("_text")))
    docs = docs.withColumn("_lines", F.filter(F.split("_text", "\n"), lambda s: F.btrim(s, F.lit(" \t\n\x0b\x0c\r")) != ""))
    docs = repeat_words(docs, "_words", "n_repeat_words")
    stops = stop_word_list()
    docs = docs.select(
        *[c for c in docs.columns if c not in ("_text", "_words", "_lines")],
        F.size("_words").cast("long").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        count_chars(F.col("_text"), SYMBOLS).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.size("_lines").cast("long").alias("n_lines"),
        F.size(F.filter("_words", lambda w: w.isin(stops))).cast("long").alias("n_stop_words"),
        F.size(F.array_distinct("_words")).cast("long").alias("n_different_words"),
        count_chars(F.col("_text"), "!").cast("long").alias("n_exclaims"),
        count_chars(F.col("_text"), r"\p{Lu}").cast("long").alias("n_upper"),
        F.size(F.filter("_lines", lambda s: s.rlike("^[ \t]*[-*•·]"))).cast("long").alias("n_bullet_lines"),
        F.size(F.filter("_lines", lambda s: s.rlike("(\\.\\.\\.|…)[ \t\r]*$"))).cast("long").alias("n_ellipsis_lines"),
    )
    ratio = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))
    return docs.withColumns({
        "mean_word_chars": ratio("word_chars", "n_words"),
        "symbol_ratio": ratio("n_symbols", "n_words"),
        "upper_ratio": ratio("n_upper", "word_chars"),
        "exclaim_ratio": ratio("n_exclaims", "n_words"),
        "stop_ratio": ratio("n_stop_words", "n_words"),
        "dup_line_ratio": ratio("n_dup_lines", "n_lines"),
        "bullet_line_ratio": ratio("n_bullet_lines", "n_lines"),
        "ellipsis_line_ratio": ratio("n_ellipsis_lines", "n_lines"),
        "repeat_ratio": ratio("n_repeat_words", "n_words"),
    })


def verdict(rules: tuple[Rule, ...] = RULES) -> Column:
    """True where no rule of the table is broken."""
    ok = F.lit(True)
    for r in rules:
        inside = F.lit(True)
        if r.low is not None:
            inside = inside & (F.col(r.metric) >= r.low)
        if r.high is not None:
            inside = inside & (F.col(r.metric) <= r.high)
        ok = ok & ((F.col("n_words") < r.from_words) | inside) if r.from_words else ok & inside
    return ok


def apply_rules(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """All columns of docs, every metric, base_failed (too few or too many repeated words) and kept."""
    base = (F.col("n_words") < 10) | (F.lit(100) * F.col("n_repeat_words") > F.lit(20) * F.col("n_words"))
    return measure(docs, text).withColumn("base_failed", base).withColumn("kept", ~F.col("base_failed") & verdict(rules))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return apply_rules(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def oracle() -> str:
    stops = ", ".join(f"'{w}'" for w in stop_word_list())
    rules = []
    for r in RULES:
        inside = " and ".join(
            ([f"{r.metric} >= {r.low}"] if r.low is not None else []) + ([f"{r.metric} <= {r.high}"] if r.high is not None else [])
        )
        rules.append(f"(n_words < {r.from_words} or ({inside}))" if r.from_words else f"({inside})")
    return rf"""
with d as (select doc_id, coalesce(text, '') as t from documents),
w as (select doc_id, t, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') as ws,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as ls from d),
g as (select doc_id, unnest(range(1, len(ws) - {WINDOW - 2})) as i, ws from w where len(ws) >= {WINDOW}),
h as (select doc_id, i, ws[i:i + {WINDOW - 1}] as gram from g),
k as (select doc_id, i from h qualify count(*) over (partition by doc_id, gram) > 1),
p as (select distinct doc_id, unnest(range(i, i + {WINDOW})) as at from k),
r as (select doc_id, count(*) as n from p group by 1),
m as (
  select w.doc_id, len(ws) as n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) as word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) as n_symbols,
    len(ls) - len(list_distinct(ls)) as n_dup_lines, coalesce(r.n, 0) as n_repeat_words, len(ls) as n_lines,
    len(list_filter(ws, lambda x: list_contains([{stops}], x))) as n_stop_words, len(list_distinct(ws)) as n_different_words, length(regexp_replace(t, '[^!]', '', 'g')) as n_exclaims,
    length(regexp_replace(t, '[^\p{{Lu}}]+', '', 'g')) as n_upper,
    len(list_filter(ls, lambda x: regexp_matches(x, '^[ \t]*[-*•·]'))) as n_bullet_lines,
    len(list_filter(ls, lambda x: regexp_matches(x, '(\.\.\.|…)[ \t\r]*$'))) as n_ellipsis_lines
  from w left join r using (doc_id)),
q as (
  select *, coalesce(word_chars / nullif(n_words, 0), 0) as mean_word_chars, coalesce(n_symbols / nullif(n_words, 0), 0) as symbol_ratio,
    coalesce(n_upper / nullif(word_chars, 0), 0) as upper_ratio, coalesce(n_exclaims / nullif(n_words, 0), 0) as exclaim_ratio,
    coalesce(n_stop_words / nullif(n_words, 0), 0) as stop_ratio, coalesce(n_dup_lines / nullif(n_lines, 0), 0) as dup_line_ratio,
    coalesce(n_bullet_lines / nullif(n_lines, 0), 0) as bullet_line_ratio, coalesce(n_ellipsis_lines / nullif(n_lines, 0), 0) as ellipsis_line_ratio,
    n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed
  from m)
select doc_id, n_words::bigint as n_words, word_chars::bigint as word_chars, n_symbols::bigint as n_symbols,
  n_dup_lines::bigint as n_dup_lines, n_repeat_words::bigint as n_repeat_words, base_failed,
  not base_failed and {" and ".join(rules)} as kept
from q"""
