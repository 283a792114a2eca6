"""Exact duplicates, importance resampling and tokenizer alignment against brute force, odd rows included."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict
from hashlib import sha256

import duckdb
import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import alignment as A13, exact_dedup as E11, importance as I12
from ledgerloom.llm.queries import OP11_SQL, QUERIES, vocabulary

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string"


def given(table="documents", column="doc_id"):
    t = pq.read_table(f"{SF}/{table}.parquet")
    return list(zip(t.column(column).to_pylist(), t.column("text").to_pylist(), strict=True))


def odd_rows(seed):
    rng = random.Random(seed)
    odd = [None, "", " ", "\n", "a", "A b", "  two  spaces ", "line\n\n\nline \n x", "tab\tand\t\tmore", "I'll we've 'tis don 't", "naïve café Ünï 漢字かな  漢字", "🙂🙃 🙂", "x▁y", "▁", "　wide space\x1cfs\x85nel",
           "<s> </s> <unk> <|endoftext|> <0x41>", "a\x00b", "1234567890 12 3", "é ﻿ bom", "word " * 3000, "aaaa" * 500, "KK ſ İ", "....---- !!??", "\r\n\r\nend  "]
    alphabet = "ab é\n\t  漢🙂'.1▁"
    odd += ["".join(rng.choice(alphabet) for _ in range(rng.randrange(40))) for _ in range(60)]
    return list(enumerate(odd))


# Exact duplicates


def brute_groups(rows, keep):
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    pick = {"largest": max, "smallest": min}[keep]
    return sorted((i, pick(groups[t or ""]), len(groups[t or ""]), sha256((t or "").encode()).hexdigest()) for i, t in rows)


@pytest.mark.parametrize(("keep", "partitions"), [("largest", "4"), ("smallest", "64")])
def test_exact_duplicates_against_brute_force(spark, keep, partitions):
    rng = random.Random(11)
    rows = [(i, rng.choice(["hot", "hot", "hot", f"t{i % 97}", f"unique {i}", None, "", "Hot", "hot "])) for i in range(6000)] + [(9000, "x" * 300_000), (9001, "x" * 300_000), (9002, "x" * 299_999)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        df = spark.createDataFrame(rows, SCHEMA).repartition(7).selectExpr("doc_id", "text", "7 as kept", "'a' as run", "1 as rows", "2 as best")
        got = E11.exact_duplicates(df, keep).collect()
        stay = sorted(r.doc_id for r in E11.distinct_documents(df, keep).collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert sorted((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == brute_groups(rows, keep)
    assert all(r.kept == (r.doc_id == r.keep_id) for r in got)
    assert stay == sorted({k for _, k, _, _ in brute_groups(rows, keep)})


def test_exact_duplicates_odd_rows(spark):
    rows = [(1, "a"), (1, "a"), (None, "a"), (None, "b"), (None, "b"), (2, None), (3, "")]
    for keep, best in (("largest", 3), ("smallest", 2)):
        got = E11.exact_duplicates(spark.createDataFrame(rows, SCHEMA), keep).collect()
        assert Counter((r.doc_id, r.keep_id, r.group_size) for r in got) == {(1, 1, 3): 2, (None, 1, 3): 1, (None, None, 2): 2, (2, best, 2): 1, (3, best, 2): 1}
        assert Counter((r.text_sha256, r.kept) for r in got if r.kept) == {(sha256(t.encode()).hexdigest(), True): 1 for t in ("a", "b", "")}
    empty = spark.createDataFrame([], SCHEMA)
    assert E11.exact_duplicates(empty).collect() == [] and E11.distinct_documents(empty).collect() == []


def test_exact_duplicates_stay_on_the_jvm(spark):
    plan = E11.exact_duplicates(spark.createDataFrame([(1, "a")], SCHEMA).repartition(2))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "SortAggregate" in plan
    assert E11.rounds(16) == [7, 8] and E11.rounds(256) == [7, 56, 192] and E11.rounds(2) == [1]


def test_op11_on_a_given_table(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = con.execute(OP11_SQL).fetchall()
    assert sorted(map(tuple, QUERIES["op11_exact_dedup"](spark, SF).collect())) == sorted(want)


# Importance resampling


def brute_draw(rows, target, percent=10, longest=1, buckets=10_000, least=20, seed="2024"):
    def words(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))

    def features(t):
        w = words(t)
        return [zlib.crc32(" ".join(w[i : i + n]).encode()) % buckets for n in range(1, longest + 1) for i in range(len(w) - n + 1)]

    s, t = Counter(b for _, x in rows for b in features(x)), Counter(b for x in target for b in features(x))
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets)))) for b in range(buckets)]
    out, fit = {}, []
    for i, x in rows:
        f = features(x)
        h = int(sha256(f"{seed}:{i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f)
        out[i] = [len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None]
        if len(words(x)) >= least:
            fit.append((-out[i][2], i))
    for rank, (_, i) in enumerate(sorted(fit)[: percent * len(fit) // 100], 1):
        out[i][3] = rank
    return out


@pytest.mark.parametrize(("longest", "buckets", "percent"), [(1, 10_000, 10), (2, 50, 37), (3, 1000, 100)])
def test_importance_against_brute_force(spark, longest, buckets, percent):
    rng = random.Random(longest)
    rows = odd_rows(12) + [(100 + i, " ".join(rng.choice(["Ka", "lo.", "MI", "é", "tu-re", "9"]) for _ in range(rng.randrange(60)))) for i in range(120)]
    target = ["ka LO mi", None, "", "tu 9 é " * 20]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5).selectExpr("*", "1 as weight", "2 as buckets", "'x' as _tag2")
    got = I12.importance_draw(df, spark.createDataFrame([(t, 5) for t in target], "text string, doc_id long"), percent, longest, buckets)
    assert {r.doc_id: [r.n_features, r.weight, r.score, r["rank"]] for r in got.collect()} == brute_draw(rows, target, percent, longest, buckets)


def test_importance_odd_rows(spark):
    empty, text = spark.createDataFrame([], SCHEMA), "word " * 30
    assert I12.importance_draw(empty, empty).collect() == []
    got = I12.importance_draw(spark.createDataFrame([(5, text), (5, text), (None, text), (6, "few"), (None, None)], SCHEMA), empty, percent=100).collect()
    assert sorted((r.doc_id or 0, r["rank"] is not None) for r in got) == [(0, False), (0, True), (5, True), (5, True), (6, False)]
    assert sorted(r["rank"] for r in got if r["rank"]) == [1, 2, 3]
    gain = I12.bucket_gains(np.array([90, 1] + [0] * 9998), np.zeros(10_000, int))[0]
    assert {r.weight for r in got if r.n_features == 30} == {30 * gain} and {r.weight for r in got if r.doc_id is None and not r.n_features} == {0}


def test_op12_on_a_given_table(spark):
    got = {r.doc_id: [r.n_features, r.weight, r.score, r["rank"]] for r in QUERIES["op12_importance_resampling"](spark, SF).collect()}
    assert got == brute_draw(given(), [t for _, t in given("benchmark", "item_id")])
    assert all(t in ("bigint",) for _, t in QUERIES["op12_importance_resampling"](spark, SF).dtypes)


# Tokenizer alignment


def brute_alignment(rows):
    """Whole texts, a token at a time."""
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=vocabulary("piece_bpe_32k.model"))
    alphabet = A13.byte_alphabet()
    spell_a = lambda i: bytes(alphabet[c] for c in a.id_to_token(i))
    spell_b = lambda i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", b.id_to_piece(i)) else b.id_to_piece(i).replace("▁", " ").encode()
    links, groups, sizes, counts = [], [], [], Counter()
    for _, text in rows:
        x, y = (a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)) if text else ([], [])
        if text and not b"".join(map(spell_a, x)) == b"".join(map(spell_b, y)) == (" " + text).encode():
            x = y = []
        ranges = []
        for ids, spell in ((x, spell_a), (y, spell_b)):
            at, out = 0, []
            for i in ids:
                out.append((at, at := at + len(spell(i)), i))
            ranges.append(out)
        found, j = [], 0
        for s, e, i in ranges[0]:
            while ranges[1][j][1] <= s:
                j += 1
            k = j
            while k < len(ranges[1]) and ranges[1][k][0] < e:
                found.append((i, ranges[1][k][2]))
                k += 1
        both = sorted({e for _, e, _ in ranges[0]} & {e for _, e, _ in ranges[1]})
        parts, low = [], 0
        for end in both:
            parts.append("|".join(",".join(str(i) for s, e, i in side if low <= s and e <= end) for side in ranges))
            low = end
        links.append(Counter(found))
        sizes.append((len(x), len(y), len(both), len(found)))
        groups.append(sha256(";".join(parts).encode()).hexdigest() if x else "")
        counts.update(set(found))
    best = defaultdict(int)
    for (i, _), n in counts.items():
        best[i] = max(best[i], n)
    return sorted((d, *s, sum(n for p, n in l.items() if counts[p] == best[p[0]]), sum(n * counts[p] for p, n in l.items()), g) for (d, _), s, l, g in zip(rows, sizes, links, groups, strict=True))


def test_alignment_against_brute_force(spark):
    rows = odd_rows(13)
    rows += [(500, rows[9][1]), (501, rows[9][1])]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3).selectExpr("*", "1 as n_a", "2 as block", "'x' as pairs")
    got = A13.align_tokenizers(df, vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model"))
    assert got.columns == ["doc_id", *A13.COLUMNS, "groups_sha256"]
    assert sorted(map(tuple, got.collect())) == brute_alignment(rows)


def test_alignment_odd_rows(spark):
    vocabularies = vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model")
    assert A13.align_tokenizers(spark.createDataFrame([], SCHEMA), *vocabularies).collect() == []
    got = A13.align_tokenizers(spark.createDataFrame([(None, "one two"), (1, "one two"), (1, "one two"), (2, None)], SCHEMA), *vocabularies).collect()
    assert len({tuple(r)[1:] for r in got if r.doc_id != 2}) == 1 and {tuple(r)[1:] for r in got if r.doc_id == 2} == {(0, 0, 0, 0, 0, 0, "")}
    assert [(r.count_sum, r.n_links) for r in got if r.doc_id == 1] == [(6, 2)] * 2


def test_chunks_forgotten_make_no_difference(monkeypatch):
    monkeypatch.setattr(A13, "CHUNKS_KEPT", 3)
    w = A13.Aligner(vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model"))
    first = [x.tolist() if hasattr(x, "tolist") else x for x in w.align(["some words here", "and some more"])]
    assert [x.tolist() if hasattr(x, "tolist") else x for x in w.align(["some words here", "and some more"])] == first


def test_op13_on_a_given_table(spark):
    assert sorted(map(tuple, QUERIES["op13_tokenizer_alignment"](spark, SF).collect())) == brute_alignment(given())


def test_url_with_very_many_labels(spark):
    from ledgerloom.llm import url_filter as U9
    from ledgerloom.llm.queries import URL_RULES

    urls = ["http://" + "a." * 20_000 + "example.org/es/x", "http://" + "b." * 20_000 + "com/de/", "http://org/", "http://com.", "http://x.example.org/en/12", None]
    got = U9.filter_urls(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), URL_RULES).collect()
    assert {r.page_id: (r.rule, r.verdict) for r in got} == {0: ("example.org/es/", "block"), 1: ("com/de/", "block"), 2: ("org/", "allow"), 3: (None, "allow"), 4: ("example.org/en/1", "block"), 5: (None, "allow")}
