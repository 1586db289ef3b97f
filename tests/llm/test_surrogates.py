"""Surrogates over the letters of all of Unicode, and the shapes that they keep."""

import re
import sys
import unicodedata

from tallyframe.llm import pii

KEY = b"key"


def every_block():
    """A letter of each block of 64 code points that has one, and the compatibility letters, which composing changes."""
    letters = [chr(i) for i in range(sys.maxunicode + 1) if not 0xD800 <= i < 0xE000 and unicodedata.category(chr(i))[0] == "L"]
    return list({ord(c) // 64: c for c in letters}.values()) + [chr(i) for i in range(0xF900, 0xFB00, 7) if chr(i).isalpha()]


def test_a_letter_of_every_block():
    for c in every_block():
        pool = pii.letters_like(c)
        assert pool and pool.isalpha()
        assert len(pii.surrogate("secret", c * 9, 0, KEY)) == 9
        local, _, domain = pii.surrogate("email", f"{c}@example.com", 0, KEY).partition("@")
        assert len(local) == 1 and domain.endswith(".com") and len(domain) == len("example.com")
        assert pii.surrogate("given", c * 3, 0, KEY, "f") and pii.surrogate("family", c * 3, 9, KEY)
    assert pii._pool.cache_info().currsize <= 1024


def test_letters_of_every_block_as_texts(spark):
    rows = [(n, f"write to {c}@example.com or Dr. {c}{c}{c}") for n, c in enumerate(every_block())]
    got = {r.doc_id: r.text for r in pii.replace(spark.createDataFrame(rows, "doc_id long, text string"), key=KEY).collect()}
    assert len(got) == len(rows)


def test_addresses_keep_labels_script_and_top_level_name(spark):
    texts = ["x@münchen.de", "y.z@münchen.de", "Y.Z@MÜNCHEN.DE", "a@b.mail.пример.рф", "豈a@example.com", "Dr. 豈更"]
    got = [r.text for r in pii.replace(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1), key=KEY).orderBy("doc_id").collect()]
    domains = [t.rpartition("@")[2] for t in got]
    assert domains[0] == domains[1] == domains[2] and got[1] == got[2] and got[0] != got[1]
    assert re.fullmatch(r"[a-zß-ÿ]{7}\.de", domains[0]) and domains[0] != "münchen.de"
    assert re.fullmatch(r"[a-z]\.[a-z]{4}\.[а-џ]{6}\.рф", domains[3])
    assert got[4] != texts[4] and re.fullmatch(r"[一-龥][a-z]@[a-z]{7}\.com", got[4]) and got[5].startswith("Dr. ") and "豈" not in got[5]


def test_digits_keep_their_script(spark):
    arabic = str.maketrans("0123456789", "٠١٢٣٤٥٦٧٨٩")
    rows = [(1, "4111 1111 1111 1111"), (2, "4111 1111 1111 1111".translate(arabic)), (3, "123-45-6789".translate(arabic)), (4, "123-45-6789")]
    got = {r.doc_id: r.text for r in pii.replace(spark.createDataFrame(rows, "doc_id long, text string"), key=KEY).collect()}
    assert got[1] != rows[0][1] and got[2] == got[1].translate(arabic) and got[3] == got[4].translate(arabic) and got[4] != "123-45-6789"


def test_short_addresses_do_not_run_out(spark):
    rows = [(i, f"{a}@x.com {a}{b}@x.com") for i, (a, b) in enumerate((a, b) for a in "abcdefghijklmnopqrstuvwxyz" for b in "abc")]
    got = [w for r in pii.replace(spark.createDataFrame(rows, "doc_id long, text string"), key=KEY).collect() for w in r.text.split()]
    assert len(set(got)) == 26 + 78
