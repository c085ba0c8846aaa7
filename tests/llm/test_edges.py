"""Texts of some megabytes, tables without rows and rows that repeat over many partitions."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
from test_operators import ALNUM, LOW, TOKENIZER, brute_secrets, plain_notices
from tokenizers import Tokenizer

from wayfinder.llm import ann, licenses, packing, secrets


def test_licenses_in_a_text_of_megabytes(spark):
    notice = licenses.NOTICES[0][0]
    filler = "some plain words that say nothing of it " * 60_000
    text = f"{notice} {filler} licensed CC BY 4.0 {filler} {notice} all rights reserved"
    row = licenses.scan_licenses(spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string")).where("doc_id = 1").head()
    words = ALNUM.findall(text.translate(LOW))
    at = sorted(k for p, _ in licenses.BASE_PHRASES for k in range(len(words)) if words[k] == p.split()[0] and words[k : k + len(p.split())] == p.split())
    assert (row["n_words"], row["n_base"], row["first_word"], row["last_word"]) == (len(words), len(at), at[0], at[-1])
    ends = [(x["begin"], x["end"]) for x in row["spans"] if x["label"] == licenses.NOTICES[0][1]]
    n = len(notice.split())
    assert (0, n) in ends and any(b > len(words) - 2 * n for b, _ in ends)
    assert plain_notices(notice.split())[0][1:] == (0, n)


def test_secrets_in_a_text_of_megabytes(spark):
    filler = "é plain text without any of it " * 70_000
    text = f"password = 'abcDEF123456' {filler} AKIAABCDEFGHIJKLMN {filler} {'0af3' * 10}"
    got = secrets.digest(secrets.find_secrets(spark.createDataFrame([(1, text)], "doc_id long, text string"))).head()
    spans = brute_secrets(text)
    assert got["spans"] == ",".join(f"{k}:{a}:{b}" for k, a, b in spans) and (got["n_assign"], got["n_access"], got["n_hex"]) == (1, 1, 1)


def test_search_over_a_table_without_rows(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    some = spark.createDataFrame([(0, [1.0, 0.0])], "vec_id long, embedding array<float>")
    assert ann.search(none, none).count() == 0 and ann.search(none, some).count() == 0 and ann.search(some, none).count() == 0


def test_packing_of_rows_that_repeat_over_partitions(spark):
    """Each row is packed whole, once, wherever its repetitions lie; sequences are gapless and full but for powers of two."""
    texts = ["the same words again", None, "", "long " * 3000]
    rows = [(i % 3 if i % 5 else None, texts[i % 4]) for i in range(240)]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, text string").repartition(7), public_tokenizers.path(TOKENIZER)).collect()
    whole = Tokenizer.from_file(public_tokenizers.path(TOKENIZER))
    ids = {t: np.array(whole.encode(t or "", add_special_tokens=False).ids + [2], "<u4") for t in texts}
    pieces = Counter((r["doc_id"], r["doc_tokens"], r["start"], r["length"], r["ids_crc32"]) for r in got)
    for (doc, total, start, length, crc), n in pieces.items():
        assert any(len(x) == total and zlib.crc32(x[start : start + length].tobytes()) == crc for x in ids.values())
    covered = Counter()
    for (doc, total, start, length, _), n in pieces.items():
        covered[doc, total] += n * length
    want = Counter()
    for d, t in rows:
        want[d, len(ids[t])] += len(ids[t])
    assert covered == want
    filled = defaultdict(list)
    for r in got:
        filled[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in filled.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= packing.SEQUENCE
