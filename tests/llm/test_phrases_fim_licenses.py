"""Phrase collocations, license scan and fill-in-the-middle against brute force, on whole small tables and on odd rows."""

import hashlib
import random
import re
from collections import Counter, defaultdict
from re import _constants as sre
from re import _parser as sre_parser

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftwell.llm import fim, license_scan, phrases, queries
from siftwell.llm.common import table

UPPER = {c: c + 32 for c in range(65, 91)}
ODD = "doc_id long, text string, lang string, n long, row long, fim string, licenses string, uid string, wanted string"


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "text", "lang").collect()


@pytest.fixture(scope="module")
def odd_docs(spark):
    long = "Never ending, story about GNU general public license version 3. " * 40_000
    texts = [None, "", " \t\n", "a", "<P> marked", "é  x cc by 4.0", long, "cc by. CC-BY! all rights reserved", "A b a b a b; a b", "ÄÖ AK"]
    rows = [(i if i % 4 else None, t, (None, "en", "und")[i % 3], 1, 2, "x", "y", "z", "w") for i, t in enumerate(texts * 2)]
    return spark.createDataFrame(rows, ODD)


# ---- phrases


def brute_collocations(rows, min_count, top):
    by, out = defaultdict(list), []
    for lang, text in rows:
        by["und" if lang is None else lang].append((text or "").translate(UPPER))
    for lang, texts in by.items():
        f, n = Counter(), 0
        for t in texts:
            for piece in re.split(r"[.,;:!?\x0A-\x0D]", t):
                words = re.findall(r"[^\x20\x09]+", piece)
                n += len(words)
                f.update(tuple(words[i : i + m]) for m in range(1, 5) for i in range(len(words) - m + 1))
        held = {p: a for p, a in f.items() if len(p) > 1 and a >= min_count}
        inside = {q[i : i + m] for q, a in held.items() for m in range(2, len(q)) for i in range(len(q) - m + 1) if 100 * a >= 80 * held[q[i : i + m]]}
        found = []
        for p, a in held.items():
            if p not in inside:
                score, _, left, right = min((2_000_000 * a // (f[p[:k]] + f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
                found.append((-score, -a, " ".join(p).encode(), left, right))
        out += [(lang, i + 1, p.decode(), -a, left, right, n, -s) for i, (s, a, p, left, right) in enumerate(sorted(found)[:top])]
    return sorted(out)


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("options", [{}, {"shard_words": 500}, {"filter_bits": 1 << 12}])
def test_collocations_are_those_of_brute_force(spark, sf_dir, docs, options):
    found = phrases.collocations(table(spark, sf_dir, "documents").repartition(5), min_count=4, top=300, **options)
    assert found.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert rows_of(found) == brute_collocations([(r["lang"], r["text"]) for r in docs], 4, 300)


def test_op11_query(spark, sf_dir):
    base = sf_dir.replace("sf0.001", "sf0.01")
    rows = [(r["lang"], r["text"]) for r in table(spark, base, "documents").collect()]
    want = brute_collocations(rows, 30, 2000)
    assert want and rows_of(queries.op11_collocations(spark, base)) == want


def test_collocations_of_odd_rows(spark, odd_docs):
    want = brute_collocations([(r["lang"], r["text"]) for r in odd_docs.collect()], 3, 50)
    assert want and rows_of(phrases.collocations(odd_docs, min_count=3, top=50)) == want
    assert phrases.collocations(odd_docs.limit(0)).count() == 0


def test_collocations_with_ties_hot_texts_and_parts_of_a_language(spark, monkeypatch):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(40)]
    rows = [(i, " ".join(rng.choices(words, k=30)), "en") for i in range(60)] + [(100 + i, "the hot text: always alike, always the same", "en") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(7)
    want = brute_collocations([(r[2], r[1]) for r in rows], 2, 100)
    assert len(want) == 100 and rows_of(phrases.collocations(docs, min_count=2, top=100, shard_words=64)) == want


def test_suffix_automaton_has_the_classes_of_the_definition():
    rng = np.random.default_rng(3)
    for n, letters, depth in ((1, 1, 4), (60, 2, 4), (300, 3, 4), (200, 4, 2), (150, 2, 3)):
        word, piece = rng.integers(0, letters, n).astype(np.uint64), np.cumsum(rng.random(n) < 0.15)
        ends = defaultdict(set)
        for i in range(n):
            for m in range(1, depth + 1):
                if i - m + 1 >= 0 and piece[i - m + 1] == piece[i]:
                    ends[tuple(word[i - m + 1 : i + 1].tolist())].add(i)
        classes = defaultdict(list)
        for p, e in ends.items():
            classes[frozenset(e)].append(p)
        a = phrases.suffix_automaton(word, piece, depth)
        states = {tuple(word[e - h + 1 : e + 1].tolist()): k for k, (e, h) in enumerate(zip(a.end, a.high, strict=True))}
        assert len(states) == len(classes) == len(a.end)
        for e, ps in classes.items():
            longest, shortest = max(ps, key=len), min(ps, key=len)
            k = states[longest]
            assert (a.low[k], a.high[k], a.count[k]) == (len(shortest), len(longest), len(e))
            assert a.link[k] == (-1 if len(shortest) == 1 else next(states[max(q, key=len)] for f, q in classes.items() if shortest[1:] in q))
        end, many, count = a.phrases()
        assert {tuple(word[i - m + 1 : i + 1].tolist()): c for i, m, c in zip(end, many, count, strict=True)} == {p: len(e) for p, e in ends.items()}


# ---- licenses


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(UPPER))


def brute_licenses(text):
    """(detections, score): every rule on every text, containment pair by pair."""
    words, found = words_of(text), []
    joined = " " + " ".join(words) + " "
    for k, r in enumerate(license_scan.RULES):
        for m in re.finditer(f"(?<= )(?:{r.pattern})(?= )", joined):
            start = joined[: m.start()].count(" ") - 1
            found.append((-r.priority, -len(m[0].split(" ")), start, k, r))
    kept = []
    for p, size, start, k, r in sorted(found, key=lambda x: x[:4]):
        if r.base or not any(s <= start and start - size <= e for s, e, _ in kept):
            kept.append((start, start - size, k))
    best = {}
    for _, _, k in kept:
        r = license_scan.RULES[k]
        best[r.label] = max(best.get(r.label, 0), r.confidence)
    return sorted(kept), 1 - float(np.prod([1 - c for c in best.values()]))


def license_texts(n=400):
    """Texts made of what the rules match, cut and mixed with other words."""
    rng = random.Random(11)

    def sample(nodes):
        out = ""
        for op, arg in nodes:
            if op is sre.LITERAL:
                out += chr(arg)
            elif op is sre.IN:
                kind, value = rng.choice(arg)
                out += chr(value) if kind is sre.LITERAL else chr(rng.randint(*value))
            elif op is sre.SUBPATTERN:
                out += sample(arg[3])
            elif op is sre.BRANCH:
                out += sample(rng.choice(arg[1]))
            else:
                out += "".join(sample(arg[2]) for _ in range(rng.randint(arg[0], min(arg[1], arg[0] + 2))))
        return out

    texts = [sample(sre_parser.parse(r.pattern)).title() for r in license_scan.RULES]
    for _ in range(n):
        parts = [rng.choice(texts) for _ in range(rng.randint(1, 6))]
        words = " ".join(p if rng.random() < 0.7 else f"{rng.choice(['x', 'of', 'Übung'])} {p}" for p in parts).split()
        if rng.random() < 0.4:
            del words[rng.randrange(len(words))]
        texts.append(rng.choice([" ", ", ", "\n", "-"]).join(words))
    return texts


def check_licenses(found, texts):
    for r in found:
        text = texts[r[0]]
        words, (want, score) = words_of(text), brute_licenses(text)
        got = r["licenses"]
        assert got["n_words"] == len(words) and got["score"] == pytest.approx(score, abs=1e-12)
        assert [(d["start"], d["end"], d["label"], d["confidence"], d["base"]) for d in got["detections"]] == [(s, e, x.label, x.confidence, x.base) for s, e, k in want for x in [license_scan.RULES[k]]]


def test_rules_match_what_the_gate_lets_through(spark):
    texts = license_texts()
    assert len(license_scan.RULES) > 200 and all(r.needs for r in license_scan.RULES)
    found = license_scan.scan(spark.createDataFrame(list(enumerate(texts)), "id long, text string")).collect()
    assert len(found) == len(texts) and all(r["licenses"]["detections"] for r in found[: len(license_scan.RULES)])
    check_licenses(found, texts)


def test_op12_query(spark, sf_dir, docs):
    phrases_of = [(p.split(), label) for p, label in license_scan.BASE_PHRASES]
    texts = {r["doc_id"]: r["text"] for r in docs}
    check_licenses(license_scan.scan(table(spark, sf_dir, "documents").select("doc_id", "text")).collect(), texts)
    found = {r["doc_id"]: r for r in queries.op12_licenses(spark, sf_dir).collect()}
    assert found.keys() == texts.keys() and any(r["n_base"] for r in found.values())
    for i, text in texts.items():
        words, r = words_of(text), found[i]
        at = [(k, label) for p, label in phrases_of for k in range(len(words)) if words[k : k + len(p)] == p]
        starts, labels = [k for k, _ in at], sorted({x for _, x in at})
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == (len(words), len(at), min(starts, default=None), max(starts, default=None), ",".join(labels))
        mine = {license_scan.RULES[k].label for _, _, k in brute_licenses(text)[0]}
        assert r["labels"] == ",".join(sorted(mine)) and set(labels) <= mine and 0 <= r["score"] <= 1


def test_licenses_of_odd_rows(odd_docs):
    found = license_scan.scan(odd_docs.withColumnRenamed("licenses", "Licenses"))
    assert found.columns == [*ODD.replace(" string", "").replace(" long", "").replace("licenses", "Licenses").split(", "), "licenses_"]
    texts = [r["text"] for r in odd_docs.collect()]
    rows = found.select("text", F.col("licenses_").alias("licenses")).collect()
    assert len(rows) == len(texts)
    check_licenses([r for r in rows if len(r["text"] or "") < 10_000], {r["text"]: r["text"] for r in rows})
    long = next(r["licenses"] for r in rows if len(r["text"] or "") > 10_000)
    assert long["n_words"] == 400_000 and len(long["detections"]) == 80_000
    assert license_scan.scan(odd_docs.limit(0)).count() == 0


# ---- fill in the middle


def brute_fim(doc_id, text):
    text = text or ""
    units = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text)
    digest, n = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest(), len(units)
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return n, "plain", None, None, text
    return (n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < 80 else (n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


@pytest.mark.parametrize("chunk_bytes", [8 << 20, 1000])
def test_fim_is_that_of_brute_force_and_goes_back(spark, sf_dir, docs, chunk_bytes):
    done = fim.fill_in_middle(table(spark, sf_dir, "documents").select("text", "doc_id"), chunk_bytes=chunk_bytes)
    forms = Counter()
    for r in done.withColumn("restored", fim.restore(F.col("fim.output"), F.col("fim.form"))).collect():
        assert tuple(r["fim"]) == brute_fim(r["doc_id"], r["text"])
        assert r["restored"] == (r["text"] or "")
        forms[r["fim"]["form"]] += 1
    assert len(forms) == 3 and sum(forms.values()) == len(docs)


def test_fim_of_odd_rows(odd_docs):
    found = fim.fill_in_middle(odd_docs)
    assert found.columns[-1] == "fim_" and found.columns[:-1] == odd_docs.columns
    rows = found.withColumn("restored", fim.restore(F.col("fim_.output"), F.col("fim_.form"))).collect()
    assert len(rows) == odd_docs.count()
    for r in rows:
        assert tuple(r["fim_"]) == brute_fim(r["doc_id"], r["text"]) and r["restored"] == (r["text"] or "")
    assert fim.fill_in_middle(odd_docs.limit(0)).count() == 0


def test_fim_keeps_bytes_that_are_no_text(spark):
    raw = spark.range(40).selectExpr("id AS doc_id", "cast(unhex('61FF2062C320') AS string) AS text")
    back = fim.fill_in_middle(raw).select("doc_id", "fim.form", F.hex(fim.restore(F.col("fim.output"), F.col("fim.form")).cast("binary")).alias("back")).collect()
    assert {r["back"] for r in back} == {"61FF2062C320"} and {r["form"] for r in back} == {"plain", "psm", "spm"}


def test_op13_query_equals_its_sql(spark, sf_dir):
    import duckdb

    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    found = queries.op13_fim(spark, sf_dir)
    want = con.sql(queries.ORACLE_SQL["op13_fim"])
    assert found.columns == want.columns
    assert rows_of(found.na.fill(-1)) == sorted(tuple(-1 if x is None else x for x in r) for r in want.fetchall())
