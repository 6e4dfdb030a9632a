"""Quality rules, personal data, fingerprints, licenses and BPE against plain Python on small texts."""

import hashlib
import os
import random
import re
from collections import Counter

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from panelweave.llm import bpe, fingerprints, licenses, pii, quality_rules

SMALL = "/root/testdata/sf0.001"
EDGE = [None, "", " ", "\n\n", "a", "word " * 30, "x" * 5000, "é😀 " * 40, "same line of words\nsame line of words\nother", "# $ % <b> | a&b"]
SCHEMA = "doc_id long, text string, source string, spans string, n_words int"


def rows_of(texts, source=lambda i: f"s{i % 3}"):
    return [(i, t, source(i), "taken", 7) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def mixed_texts():
    rng = random.Random(7)
    bits = ["a@b.co", "_", "4111 1111 1111 1111", "+1 (415) 555-2671", "1.2.3.4", "256.1.1.1", ".", "-", "@", " ", "x", "é", "😀", "DE89370400440532013000", "ssn 123-45-6789", "call 415-555-2671", "7", "+", "("]
    return EDGE + ["".join(rng.choice(bits) for _ in range(rng.randrange(1, 25))) for _ in range(300)]


def plain_rules(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
    seen = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = {j for i in range(len(w) - 7) if seen[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(covered)


def test_rules_equal_plain_python(spark):
    rng = random.Random(3)
    texts = EDGE + [" ".join(rng.choice("a b c d\n e|".split(" ")) for _ in range(rng.randrange(60))) for _ in range(100)]
    got = quality_rules.op2(spark.createDataFrame(rows_of(texts), SCHEMA)).collect()
    assert len(got) == len(texts)
    for r in got:
        assert plain_rules(texts[r.doc_id]) == (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
        assert not (r.base_failed and r.kept)


def test_bad_host_takes_its_documents_along(spark):
    good = " ".join(f"w{i}" for i in range(40))
    rows = [(i, good if i % 10 == 0 else "short", "bad", "", 0) for i in range(200)] + [(1000 + i, good, f"h{i % 20}", "", 0) for i in range(400)] + [(5000, good, None, "", 0)] * 2
    got = {(r.doc_id, r.kept) for r in quality_rules.op2(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert not any(k for i, k in got if i < 1000) and all(k for i, k in got if 1000 <= i < 5000) and (5000, True) in got
    assert quality_rules.op2(spark.createDataFrame([], SCHEMA)).collect() == []


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test data")
def test_rules_equal_their_sql(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SMALL}/documents.parquet'")
    want = con.execute(quality_rules.SQL)
    names = [c[0] for c in want.description]
    got = quality_rules.op2(spark.read.parquet(f"{SMALL}/documents.parquet")).select(*names).collect()
    assert sorted(map(tuple, got)) == sorted(want.fetchall())


def luhn(s):
    total = 0
    for i, c in enumerate(reversed(s)):
        d = int(c) * (2 if i % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


PLAIN = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 14 <= len(x := re.sub("[^0-9]", "", m)) <= 19 and luhn(x)),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 10 <= len(re.sub("[^0-9]", "", m)) <= 15),
)


def test_base_spans_equal_plain_python(spark, mixed_texts):
    for r in pii.op3(spark.createDataFrame(rows_of(mixed_texts), SCHEMA)).collect():
        want = sorted((m.start(), k, m.end()) for k, (_, p, ok) in enumerate(PLAIN) for m in re.finditer(p, mixed_texts[r.doc_id] or "") if ok(m[0]))
        said = ",".join(f"{PLAIN[k][0]}:{a}:{b}" for a, k, b in want)
        assert r.base_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == j for _, k, _ in want) for j in range(4))
        assert set(said.split(",")) - {""} <= set(r.spans.split(","))


def test_own_kinds_need_checksum_or_context(spark):
    texts = ["pay DE89370400440532013000 now", "pay DE88370400440532013000 now", "my ssn is 123-45-6789.", "part 123-45-6789.", "call 415-555-2671", "item 415-555-2671"]
    got = [r.spans for r in pii.op3(spark.createDataFrame(rows_of(texts), SCHEMA)).orderBy("doc_id").collect()]
    assert got == ["iban:4:26", "", "ssn:10:21", "", "local_phone:5:17", ""]


def test_redaction_keeps_the_rest(spark):
    texts = ["write a@b.co 😀 or +1 (415) 555-2671!", None, "", "nothing here", "a@b.co " * 1500]
    got = [r.text for r in pii.redact(spark.createDataFrame(rows_of(texts), SCHEMA)).orderBy("doc_id").collect()]
    assert got == ["write [EMAIL] 😀 or [PHONE]!", None, "", "nothing here", "[EMAIL] " * 1500]


def test_long_runs_do_not_recurse(spark):
    texts = ["a" * 50_000, "1" * 50_000, "1-" * 30_000, "a@b" + ".c" * 30_000, "+1" + "(" * 30_000]
    got = pii.op3(spark.createDataFrame(rows_of(texts), SCHEMA)).orderBy("doc_id").collect()
    assert [r.n_email for r in got] == [0, 0, 0, 1, 0]


def test_fingerprints_of_edits_equal_direct_ones(spark):
    rng = random.Random(2)
    texts = ["", None, "a", "short text", "x" * 15, "x" * 16, "x" * 40, "😀" * 50, "abc " * 20] + ["".join(rng.choice("ab cé") for _ in range(rng.randrange(200))) for _ in range(80)]
    keys = [None, *range(1, len(texts) - 1), len(texts) - 2]  # one without an id, one id twice
    rows = [(k, t, "s", "", 0) for k, t in zip(keys, texts)]
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    plain = [r[1] or "" for r in order]
    edited = [t[: len(t) - len(t) // 2] + plain[(i + 1) % len(plain)][: len(t) // 2] for i, t in enumerate(plain)]
    direct = [r.k for r in spark.createDataFrame(list(enumerate(edited)), "i long, t string").select("i", fingerprints.kept_hashes(F.col("t")).alias("k")).orderBy("i").collect()]
    got = Counter((r.doc_id, r.n_chars, r.edited_sha256, r.edited_fingerprint) for r in fingerprints.op7(spark.createDataFrame(rows, SCHEMA)).collect())
    want = Counter((r[0], len(t), hashlib.sha256(e.encode()).hexdigest(), ",".join(map(str, k))) for r, t, e, k in zip(order, plain, edited, direct))
    assert got == want
    assert fingerprints.op7(spark.createDataFrame([], SCHEMA)).collect() == []


def test_window_keeps_rightmost_least(spark):
    text = "".join(random.Random(1).choice("abcd") for _ in range(300))
    df = spark.createDataFrame([(text,)], "t string")
    kept = df.select(fingerprints.kept_hashes(F.col("t"))).first()[0]
    grams = df.select(F.transform(F.sequence(F.lit(0), F.lit(300 - fingerprints.K)), lambda i: F.xxhash64(F.substring(F.encode("t", "UTF-32"), i * 4 + 1, F.lit(4 * fingerprints.K))))).first()[0]
    want = []
    for s in range(len(grams) - fingerprints.W + 1):
        best = min(range(s, s + fingerprints.W), key=lambda i: (grams[i] >> 32, -i))
        if not want or want[-1] != best:
            want.append(best)
    assert [fingerprints.LAST - (v & 0xFFFFFFFF) for v in kept] == want


def test_licenses(spark):
    grant = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the
    Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to
    permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all
    copies or substantial portions of the Software."""
    texts = [
        "Licensed under the Apache License, Version 2.0.", "see the APACHE license", "Licensed under CC BY-NC 4.0.", grant, grant.replace("merge", "merging"),
        "This work is licensed under the GNU General Public License, version 3. MIT License, mit license", None, "", "licenſe é",
    ]
    got = {r.doc_id: r for r in licenses.op6(spark.createDataFrame(rows_of(texts), SCHEMA)).collect()}
    assert [(got[i].base_labels, got[i].labels, got[i].n_base, got[i].score) for i in range(9)] == [
        ("apache", "apache,apache-2.0", 1, 1.0), ("apache", "apache", 1, 0.5), ("cc-by", "cc-by,cc-by-nc-4.0", 1, 1.0), ("", "mit-text", 0, 1.0), ("", "", 0, 0.0),
        ("gpl,mit", "gpl,gpl-3.0,mit", 3, 1.0), ("", "", 0, 0.0), ("", "", 0, 0.0), ("", "", 0, 0.0),
    ]
    assert (got[5].first_word, got[5].last_word, got[6].first_word, got[8].n_words) == (6, 14, None, 2)


def test_template_regions():
    a = licenses.Automaton()
    a.add("t", "one <<optional>>two <<optional>>three<<end>><<end>> <<any 2>> <<one of: x y | z>> end")
    ends = {s: a.longest(s.split(), 0).get("t") for s in ("one z end", "one two x y end more", "one two three q r z end", "one three a b c z end", "one two", "z end")}
    assert list(ends.values()) == [3, 5, 7, None, None, None]


def test_bpe_equals_the_library_both_ways(spark):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = str(public_tokenizers.path("word_bpe_49k.json"))
    rng = random.Random(5)
    bits = [*"abcéÉßñ😀ΣσςİıǅÅ", "'s", "'LL", " ", "\n", "　", "<|endoftext|>", "<|startoftext|>", "<|", "1", "½", "!", "...", "aaaaaa", "日本語", "́", "\x00", "ﬁ"]
    texts = EDGE + ["".join(rng.choice(bits) for _ in range(rng.randrange(1, 40))) for _ in range(500)] + ["a" * 5000, "ab" * 4000]
    tok = Tokenizer.from_file(path)
    tok.no_padding()
    tok.no_truncation()
    df = bpe.decode(bpe.encode(spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, tokens string"), path), path)
    for r in df.collect():
        ids = tok.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        assert r.tokens == ids and r.decoded == tok.decode(ids, skip_special_tokens=False)
    assert bpe.op4(spark.createDataFrame([], SCHEMA), path).collect() == []


def test_bpe_ids_become_texts_without_a_step_per_token():
    strings = pa.array(["a</w>", "é", ""], pa.large_string())
    ids = pa.array([None, [0, 1], [], [2, 0], None, [1] * 3, [2]], pa.list_(pa.int32()))
    want = ["", "a</w> é", "", " a</w>", "", "é é é", ""]
    assert bpe.joined(ids, strings).to_pylist() == want and bpe.joined(ids.slice(2, 4), strings).to_pylist() == want[2:6]
    assert bpe.joined(ids.slice(0, 0), strings).to_pylist() == []
