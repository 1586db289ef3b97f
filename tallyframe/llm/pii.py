"""PII: surrogate generation. Detected entities get keyed, type-consistent replacements across the whole corpus.

Detection finds e-mail addresses (in letters of any script), phone numbers, IP addresses of both versions, card and
social-security numbers, secrets (access keys, tokens and passwords in assignments) and names after a title or a phrase
such as "my name is". Spark's own regular expressions sort out the texts that can hold none; only the others reach Python.

Surrogates keep type and format: digits stay digits in the same grouping (a card number that passes its check
digit gets one that does), addresses keep their shape, letters their script and case, names their script and gender
(by the titles that stand before a name anywhere in the corpus). A surrogate is a function of a secret key, the entity's
canonical form and an attempt number, so an entity has one surrogate in all documents (coreference): e-mails compare in
lower case, cards by their digits, phone numbers without country code and trunk zero (which stay as written), names by
part, so "Mrs. Anna Berg" and "Mrs. Berg" keep their common part.

The key comes from the caller, or from the session's ``tallyframe.pii.key``; where neither names one, a random key is
drawn on the driver for this call, so surrogates then differ from run to run. There is no key in the code.

Collision checks run on the table of different entities: a surrogate that equals a real entity of its kind, one
already given, or one of the same round is drawn again (of equal ones the first entity keeps it), until all are
distinct. The table is joined back on (kind, entity); nothing is collected.

Defined results: null text stays null; empty texts and texts without entities come back unchanged; very long texts are
searched whole; overlapping matches go to the longest kind in the order of PATTERNS; repeated rows get the same text;
ids of any type and null ones pass as they are; an empty table gives no rows; all other columns are kept, whatever their
names (but _n_entities, which an own one takes the place of), and n_chars, where there is one, follows the text.

A domain is replaced by its own surrogate, so addresses of one domain keep one domain, with as many labels, in their scripts,
and the same top-level name. Surrogates that run out get longer (names and local parts after a few attempts, phone numbers
after 32); numbers of social security and IP addresses come from ranges that are not in use for 16 attempts, then from all.
"""

from __future__ import annotations

import hashlib
import hmac
import ipaddress
import re
import secrets
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache, reduce
from string import ascii_lowercase, ascii_uppercase

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, map_columns, materialize, packed, quoted, small_batches

KEY_SETTING = "tallyframe.pii.key"
MAX_ROUNDS = 64

# Titles by gender.
MALE = "Mr Herr Monsieur Sr Señor Don Sir г-н господин".split()
FEMALE = "Mrs Ms Miss Frau Mme Madame Sra Señora Doña г-жа госпожа".split()
NEUTRAL = "Dr Prof Doctor Doktor Professor Docteur Profesor".split()
CUES = ("my name is", "mein Name ist", "ich heiße", "je m'appelle", "me llamo", "mi nombre es", "меня зовут")
TITLES = "|".join(re.escape(t) for t in sorted(MALE + FEMALE + NEUTRAL, key=len, reverse=True))
CUE = "|".join(f"(?:{c[0]}|{c[0].upper()}){c[1:]}" for c in CUES)
_NAME = r"[^\W\d_a-zа-яß-öø-ÿα-ω][^\W\d_]+(?:[-'’][^\W\d_]+)?"

# Country codes of two digits; 1 and 7 are the ones of one digit, all others have three.
TWO_DIGIT_CODES = set("20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())

# Where the letters of some scripts lie.
SCRIPTS = (
    (0x00C0, 0x00FF), (0x0391, 0x03C9), (0x0400, 0x045F), (0x0531, 0x0587), (0x05D0, 0x05EA), (0x0620, 0x064A), (0x0904, 0x0939), (0x0E01, 0x0E2E),
    (0x10D0, 0x10FF), (0x3041, 0x3096), (0x30A1, 0x30FA), (0x4E00, 0x9FA5), (0xAC00, 0xD7A3),
)

#: Kind and pattern, in order of precedence.
PATTERNS = (
    ("email", r"(?<![\w.+-])[^\W_][\w.+%-]*@(?:[^\W_]|-)+(?:\.(?:[^\W_]|-)+)*\.(?:[A-Za-z]{2,}|[^\W\d_A-Za-z]{2,})"),
    ("secret", r"(?i:(?:password|passwd|pwd|token|secret|api_?key|access_?key)\"?\s*[=:]\s*[\"']?)(?P<secret>[A-Za-z0-9+/_\-]{8,})"),
    ("access_key", r"(?<![A-Za-z0-9])(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])|(?<![A-Za-z0-9])(?:ghp_|sk-|xox[bp]-)[A-Za-z0-9-]{16,}"),
    ("ip", r"(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\w]|\.\d)"),
    ("ip6", r"(?<![\w:.])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6}|(?:[0-9A-Fa-f]{1,4}:){1,7}:)(?![\w:]|\.\d)"),
    ("ssn", r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])"),
    ("card", r"(?<![\w+])\d{4}(?:[ -]?\d{4}){2}[ -]?\d{1,7}(?!\w)|(?<![\w+])3\d{3}[ -]?\d{6}[ -]?\d{5}(?!\w)"),
    ("phone", r"(?<!\w)\+\d[\d ().-]{6,18}\d(?!\w)|(?<!\w)\(\d{2,4}\)[ .-]?\d{3,4}[ .-]?\d{3,4}(?!\w)|(?<![\w.-])\d{3}[-. ]\d{3}[-. ]\d{4}(?![\w-])|(?<![\w.-])0\d{1,4}[ /-]\d{3,}(?:[ -]?\d{2,})*(?!\w)"),
    ("name", rf"(?<!\w)(?:(?P<title>{TITLES})\.?|(?:{CUE}))[  ](?P<name>{_NAME}(?: {_NAME}){{0,2}})"),
)
_ALL = re.compile("|".join(f"(?P<k_{k}>{p})" for k, p in PATTERNS))
#: What Spark asks first; every pattern above needs one of these. The last is slow, so it is asked only where one of the
#: words stands at all.
MARKS, KEY_STARTS = r"[@=:\p{Nd}]", ("AKIA", "ASIA", "ghp_", "sk-", "xox")
NAME_WORDS = (*MALE, *FEMALE, *NEUTRAL, *(c[1:] for c in CUES))
NAMED = r"(?:" + TITLES + r")\.?[  ]\p{L}|(?:" + CUE + r")[  ]\p{L}"

_SYLLABLES = {
    "latin": ("ba be bi bo da de di do fa fe ga ge go ha he ja jo ka ke ki la le li lo ma me mi mo na ne ni no pa pe ra re ri ro sa se si so ta te ti to va ve vi".split(), {"m": "n r s k d".split(), "f": "a ia na la ea".split(), "": "berg ton er mann ov es ard ic".split()}),
    "cyrillic": ("ба бе ви во га да де за зи ка ке ки ла ле ли ло ма ме ми на не ни но па ре ри ро са се си со та те ти то".split(), {"m": "н р с й м".split(), "f": "а ия на ла".split(), "": "ов ин ский енко".split()}),
}


def digits_of(surface: str) -> str:
    """The digits of any script, as ASCII ones."""
    return "".join(str(unicodedata.decimal(c)) for c in surface if c.isdecimal())


def national(surface: str) -> str:
    """A phone number's digits without country code and trunk zero."""
    digits = digits_of(surface)
    if surface.startswith("+") or digits.startswith("00"):
        digits = digits.removeprefix("00")
        n = 1 if digits[:1] in "17" else 2 if digits[:2] in TWO_DIGIT_CODES else 3
        digits = digits[n:] if len(digits) - n >= 4 else digits
    elif len(digits) == 11 and digits[0] == "1":
        digits = digits[1:]
    return digits[1:] if digits[:1] == "0" and len(digits) > 5 else digits


def canonical(kind: str, surface: str) -> str:
    if kind == "email":
        return surface.lower()
    if kind == "phone":
        return national(surface)
    if kind in ("card", "ssn"):
        return digits_of(surface)
    if kind == "ip6":
        return ipaddress.IPv6Address(surface).exploded
    if kind in ("given", "family"):
        return surface.casefold()
    return surface


def _is_address(surface: str) -> bool:
    try:
        return ipaddress.IPv6Address(surface).version == 6 and len(surface) > 4
    except ValueError:
        return False


def entities(text: str) -> list[tuple[str, int, int, str, str]]:
    """(kind, start, end, canonical form, gender), in text order, without overlaps; gender is m, f or empty."""
    out = []
    for m in _ALL.finditer(text):
        kind = next(k for k, _ in PATTERNS if m.group(f"k_{k}") is not None)
        if kind == "name":
            title = m.group("title")
            gender = "m" if title in MALE else "f" if title in FEMALE else ""
            parts = list(re.finditer(r"\S+", m.group("name")))
            for n, p in enumerate(parts):
                # A title stands before a family name, a phrase before a given one.
                given = n < len(parts) - 1 or (title is None and len(parts) == 1)
                which, at = "given" if given else "family", m.start("name") + p.start()
                out.append((which, at, at + len(p.group()), canonical(which, p.group()), gender if given else ""))
            continue
        group = "secret" if kind == "secret" else 0
        start, end = m.span(group)
        if kind == "phone" and not 7 <= sum(c.isdigit() for c in m.group()) <= 15:
            continue
        if kind == "ip6" and not _is_address(m.group()):
            continue
        out.append((kind, start, end, canonical(kind, text[start:end]), ""))
    return out


@lru_cache(maxsize=1024)
def _pool(low: int, high: int, category: str) -> str:
    """Letters of a range and category that composing leaves as they are."""
    letters = (chr(i) for i in range(low, high + 1))
    return "".join(c for c in letters if unicodedata.category(c) == category and unicodedata.normalize("NFC", c) == c)


def letters_like(c: str) -> str:
    """Letters of a character's script and case; the character alone where its range has no others that stay as they are."""
    if "a" <= c <= "z" or "A" <= c <= "Z":
        return ascii_lowercase if c >= "a" else ascii_uppercase
    c = unicodedata.normalize("NFC", c)[0]
    low, high = next(((x, y) for x, y in SCRIPTS if x <= ord(c) <= y), (ord(c) & ~63, ord(c) | 63))
    return _pool(low, high, unicodedata.category(c)) or c


def _digits(seed: bytes, n: int) -> list[int]:
    raw = b"".join(hashlib.sha256(seed + bytes([i])).digest() for i in range(n // 16 + 1))
    return [int.from_bytes(raw[2 * i : 2 * i + 2]) for i in range(n)]


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _same_shape(text: str, draws: list[int], hexadecimal: bool = False) -> str:
    out = []
    for c, r in zip(text, draws, strict=True):
        if c.isdecimal():
            out.append(chr(ord(c) - unicodedata.decimal(c) + r % 10))
        elif hexadecimal and c in "abcdef":
            out.append("abcdef"[r % 6])
        elif c.isalpha():
            pool = letters_like(c)
            out.append(pool[r % len(pool)])
        else:
            out.append(c)
    return "".join(out)


def surrogate(kind: str, entity: str, attempt: int, key: bytes, gender: str = "") -> str:
    """The canonical form of an entity's replacement, from the key, the entity and the attempt."""
    seed = hmac.new(key, f"{kind}\0{entity}\0{attempt}".encode(), hashlib.sha256).digest()
    r = _digits(seed, max(16, len(entity) + 4))
    if kind == "ip":
        # Private and reserved networks: 16 first bytes, so 268 million addresses.
        first = (10, *range(240, 255))[r[3] % 16] if attempt < 16 else 1 + r[3] % 254
        return f"{first}.{r[0] % 256}.{r[1] % 256}.{1 + r[2] % 254}"
    if kind == "ip6":
        return ":".join(["2001", "0db8", *(f"{x:04x}" for x in r[:6])])
    if kind == "ssn":
        return f"{9 if attempt < 16 else r[3] % 10}{r[0] % 100:02d}{r[1] % 100:02d}{r[2] % 10000:04d}"
    if kind == "phone":
        # The first digit is never 0 or 1. Where one length has no free number left, later attempts are longer.
        n = len(entity) + attempt // 32
        return str(2 + r[15] % 8) + "".join(str(x % 10) for x in r[: n - 1])
    if kind == "card":
        body = entity[0] + "".join(str(x % 10) for x in r[: len(entity) - 2])
        want = _luhn(entity)
        return next(body + c for c in "0123456789" if _luhn(body + c)) if want else body + str(r[-1] % 10)
    if kind == "email":
        local, _, domain = entity.rpartition("@")
        local = _same_shape(local, _digits(seed, len(local))) + "".join(chr(ord("a") + x % 26) for x in r[: attempt // 8])
        labels, _, top = domain.rpartition(".")
        own = hmac.new(key, f"domain\0{domain}".encode(), hashlib.sha256).digest()
        return f"{local}@{_same_shape(labels, _digits(own, len(labels)))}.{top}"
    if kind in ("secret", "access_key"):
        lead = re.match(r"AKIA|ASIA|ghp_|sk-|xox[bp]-", entity)
        n = lead.end() if lead else 0
        return entity[:n] + _same_shape(entity[n:], r[: len(entity) - n], bool(re.fullmatch(r"[0-9a-f]+", entity)))
    first = next((c for c in entity if c.isalpha()), "a")
    script = "cyrillic" if "а" <= first <= "ё" else "latin" if ord(first) < 0x250 else None
    if script is None:
        pool = letters_like(first)
        return "".join(pool[x % len(pool)] for x in r[: max(2, len(entity)) + attempt // 4])
    parts, ends = _SYLLABLES[script]
    ends = ends[gender] if kind == "given" and gender else [e for g in "mf" for e in ends[g]] if kind == "given" else ends[""]
    # Longer names as attempts go on, so there are always enough.
    return "".join(parts[x % len(parts)] for x in r[: 2 + attempt // 4]) + ends[r[-1] % len(ends)]


def render(kind: str, surface: str, new: str) -> str:
    """A canonical replacement in the format of the text it stands for; a phone number's code and trunk zero stay."""
    if kind in ("card", "phone", "ssn"):
        n = sum(c.isdecimal() for c in surface)
        keep = n - len(national(surface)) if kind == "phone" else 0
        digits, out = iter(new), []
        for c in surface:
            keep -= c.isdecimal()
            # In the digits of the text's script.
            out.append(chr(ord(c) - unicodedata.decimal(c) + int(next(digits))) if c.isdecimal() and keep < 0 else c)
        return "".join([*out, *digits])
    if kind in ("given", "family"):
        return new.upper() if surface.isupper() else new.capitalize()
    return new


ENTITIES = "array<struct<kind:string,start:int,end:int,entity:string,gender:string>>"


def _detect(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        found = [entities(t) for t in pdf["_text"]]
        keep = [i for i, f in enumerate(found) if f]
        if keep:
            rows = [[{"kind": k, "start": s, "end": e, "entity": c, "gender": g} for k, s, e, c, g in found[i]] for i in keep]
            yield pd.DataFrame({"_th": pdf["_th"].to_numpy()[keep], "found": rows})


def _draw(key: bytes):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(new=[surrogate(k, e, a, key, g) for k, e, a, g in zip(pdf["kind"], pdf["entity"], pdf["attempt"], pdf["gender"], strict=True)])

    return run


def is_suspect(text: Column) -> Column:
    """Whether a text can hold an entity, by built-in functions."""
    holds = lambda words: reduce(lambda a, b: a | b, [text.contains(w) for w in words])
    return text.rlike(MARKS) | holds(KEY_STARTS) | (holds(NAME_WORDS) & text.rlike(NAMED))


def key_of(spark: SparkSession) -> bytes:
    """The session's key, or a random one."""
    named = spark.conf.get(KEY_SETTING, None)
    return named.encode() if named else secrets.token_bytes(32)


def distinct_surrogates(found: DataFrame, key: bytes) -> DataFrame:
    """(kind, entity, gender) to (kind, entity, new): all new ones distinct, and none of them an entity of the corpus."""
    real = materialize(found.groupBy("kind", "entity").agg(F.max("gender").alias("gender")), "entities")
    taken = real.select("kind", F.col("entity").alias("new"))
    pending, given = real.withColumn("attempt", F.lit(0)), None
    for n in range(MAX_ROUNDS):
        drawn = materialize(pending.mapInPandas(_draw(key), "kind string, entity string, gender string, attempt int, new string"), "drawn")
        free = drawn.join(taken, ["kind", "new"], "left_anti")
        first = free.groupBy("kind", "new").agg(F.min("entity").alias("entity"))
        won = materialize(first.select("kind", "entity", "new"), "won")
        given = won if given is None else given.unionByName(won)
        taken = taken.unionByName(won.select("kind", "new"))
        pending = drawn.join(won.select("kind", "entity"), ["kind", "entity"], "left_anti").select("kind", "entity", "gender", (F.col("attempt") + 1).alias("attempt"))
        if not pending.limit(1).count():
            return given
    raise ValueError(f"no distinct surrogates after {MAX_ROUNDS} rounds")


def _rewrite() -> Callable[[list, list], dict[str, list]]:
    def run(texts: list[str], all_swaps: list[list[dict]]) -> dict[str, list]:
        out = []
        for text, swaps in zip(texts, all_swaps, strict=True):
            parts, at = [], 0
            for s in sorted(swaps, key=lambda s: s["start"]):
                parts += [text[at : s["start"]], render(s["kind"], text[s["start"] : s["end"]], s["new"])]
                at = s["end"]
            out.append("".join([*parts, text[at:]]))
        return {"_new_text": out}

    return run


def replace(docs: DataFrame, text: str = "text", key: bytes | None = None) -> DataFrame:
    """The rows of docs with their text rewritten, and _n_entities."""
    key = key or key_of(docs.sparkSession)
    small_batches(docs.sparkSession)
    held = docs.select(packed(docs, text, "_n_entities").alias("_row"), F.col(text).alias("_text"))
    suspect = F.coalesce(is_suspect(F.col("_text")), F.lit(False))
    maybe = held.where(suspect).withColumn("_th", F.xxhash64("_text", F.lit(23)))
    # By text: copies share their entities and their places.
    found = materialize(maybe.select("_th", "_text").mapInPandas(_detect, f"_th bigint, found {ENTITIES}").dropDuplicates(["_th"]), "found")
    spots = found.select("_th", F.explode("found").alias("f")).select("_th", "f.*")
    swaps = spots.join(distinct_surrogates(spots, key), ["kind", "entity"]).groupBy("_th")
    swaps = materialize(swaps.agg(F.collect_list(F.struct("kind", "start", "end", "new")).alias("_swaps")), "swaps")
    rows = maybe.join(swaps, "_th", "left")
    changed = map_columns(rows.where("_swaps is not null"), _rewrite, ["_text", "_swaps"], "_new_text string", ("_text", "_th"))
    changed = changed.select("_row", F.col("_new_text").alias("_text"), F.size("_swaps").cast("long").alias("_n_entities"))
    same = rows.where("_swaps is null").select("_row", "_text").unionByName(held.where(~suspect)).withColumn("_n_entities", F.lit(0).cast("long"))
    out = same.unionByName(changed)
    new = {text: F.col("_text"), "_n_entities": F.col("_n_entities")}
    if "n_chars" in docs.columns and text != "n_chars":
        new["n_chars"] = F.when(F.col("_n_entities") > 0, F.length("_text").cast("long")).otherwise(F.col("_row.n_chars"))
    names = [c for c in docs.columns if c != "_n_entities"]
    return out.select(*(new.get(c, F.col(f"_row.{quoted(c)}")).alias(c) for c in [*names, "_n_entities"]))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = replace(documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", F.col("_n_entities").alias("n_entities"), "text")
