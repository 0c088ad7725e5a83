"""Each stage of the pipeline against a brute-force version, with columns that clash, repeated ids, nulls and empties."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from emberlog.llm import bpe, queries, toxicity

from .test_operators import check_bins, split

STAGES = dict(corpus_pipeline.STAGES)
EXTRA = "predicted int, score double, kept string, n_words long, n_removed string, n_entities int, text_key string, ids string, Row string, won string, ranges string, w long, bits long, t1 long"
SCHEMA = f"doc_id long, text string, lang string, source string, n_chars long, {EXTRA}"


def extra(i: int) -> tuple:
    return (i, i / 2, f"k{i}", i, "r", i, "t", "i", f"row{i}", "w", "g", i, i, i)


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    r = random.Random(11)
    vocabulary = ["".join(r.choice("abcdefghij") for _ in range(r.randint(2, 7))) for _ in range(400)]
    some = lambda n: [r.choice(vocabulary) for _ in range(n)]
    a, b, hot = some(60), some(80), some(45)
    texts = [(i, " ".join(some(r.randint(20, 120)) + (["vileword"] * 3 if i % 4 == 0 else []))) for i in range(60)]
    texts += [(3, " ".join(a)), (5, " ".join(a)), (5, " ".join(b)), (70, " ".join(a) + " tail"), (71, " ".join(b)), (72, "same words here"), (72, "same words here"), (None, "same words here")]
    texts += [(80 + i, " ".join(some(20) + hot + some(20))) for i in range(4)]
    texts += [(90, f"write to anna.k@site.org {i}") for i in range(2)] + [(91, "ANNA.K@site.org and bob@site.org wrote"), (92, None), (93, ""), (None, None), (94, " \t"), (95, "x")]
    rows = [(d, t, "en", "s", None if t is None else len(t), *extra(i)) for i, (d, t) in enumerate(texts)]
    root = tmp_path_factory.mktemp("sf")
    spark.createDataFrame([(i, int(i % 4 == 0), 1) for i in range(60)], "doc_id long, toxic int, quality int").write.parquet(str(root / "labels.parquet"))
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(str(root / "documents.parquet"))
    return str(root)


def plain(df) -> Counter:
    return Counter(tuple(r) for r in df.collect())


def docs_of(spark, table):
    return spark.read.parquet(f"{table}/documents.parquet")


def test_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "substring_dedup", "pii", "packing"]


def test_toxicity(spark, table, monkeypatch):
    monkeypatch.setattr(toxicity, "STEPS", 120)
    docs = docs_of(spark, table)
    model = toxicity.fit(docs, spark.read.parquet(f"{table}/labels.parquet"), queries.learnable())
    want = [r for r in docs.collect() if toxicity.score_texts(model, [r.text])[0] < 0.5]
    got = STAGES["toxicity"](spark, docs, table)
    assert got.dtypes == docs.dtypes and plain(got) == Counter(map(tuple, want)) and len(want) < docs.count()


def test_near_duplicates(spark, table):
    docs = docs_of(spark, table)
    rows = docs.collect()
    sets = []
    for r in rows:
        w = [x.lower() for x in split(r.text)]
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set()))
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]) and group[i] != group[j]:
                old = group[i]
                group = [group[j] if g == old else g for g in group]
    best = {}
    for i, r in enumerate(rows):
        head = "-::" if r.doc_id is None else f"{len(str(r.doc_id))}:{r.doc_id}:"
        key = (r.doc_id is None, r.doc_id or 0, hashlib.sha256((head + (r.text or "")).encode()).digest())
        if sets[i]:
            best[group[i]] = min(best.get(group[i], key), key)
    want = Counter((d, t) for d, t in ((r.doc_id, r.text) for i, r in enumerate(rows) if not sets[i]))
    for i, r in enumerate(rows):
        head = "-::" if r.doc_id is None else f"{len(str(r.doc_id))}:{r.doc_id}:"
        if sets[i] and best[group[i]] == (r.doc_id is None, r.doc_id or 0, hashlib.sha256((head + r.text).encode()).digest()):
            want[r.doc_id, r.text] = 1
    got = STAGES["near_duplicates"](spark, docs, table)
    assert got.dtypes == docs.dtypes and Counter((r.doc_id, r.text) for r in got.collect()) == want
    assert plain(got) <= plain(docs)
    assert any(d == 5 and len(t) > 100 for d, t in want) and sum(t == "same words here" for _, t in want.elements()) == 1


def test_substring_dedup(spark, table):
    docs = docs_of(spark, table)
    rows = docs.collect()
    seen = Counter(tuple(w[i : i + 35]) for w in (split(r.text) for r in rows) for i in range(len(w) - 34))
    want = []
    for r in rows:
        w = split(r.text)
        gone = {j for i in range(len(w) - 34) if seen[tuple(w[i : i + 35])] > 1 for j in range(i, i + 35)}
        text = b" ".join(x for i, x in enumerate(w) if i not in gone).decode() if gone else r.text
        want.append((r.doc_id, text, r.lang, r.source, None if text is None else len(text), *r[5:]))
    got = STAGES["substring_dedup"](spark, docs, table)
    assert got.dtypes == docs.dtypes and plain(got) == Counter(want) and plain(got) != plain(docs)


def test_pii(spark, table):
    docs = docs_of(spark, table)
    got = STAGES["pii"](spark, docs, table)
    assert got.dtypes == docs.dtypes
    mail = r"[\w.]+@[\w.]+\w"
    have, want = (sorted((r.doc_id or -1, re.sub(mail, "@", r.text or "-"), *r[5:]) for r in df.collect()) for df in (got, docs))
    assert have == want
    mapped = defaultdict(set)
    new = {r.Row: r for r in got.collect()}
    for r in docs.collect():
        for old, now in zip(re.findall(mail, r.text or ""), re.findall(mail, new[r.Row].text or ""), strict=True):
            mapped[old.lower()].add(now.lower())
        assert new[r.Row].n_chars == (None if new[r.Row].text is None else len(new[r.Row].text))
    assert len(mapped) == 2 and all(len(v) == 1 for v in mapped.values()) and len(set.union(*mapped.values())) == 2 and not set.union(*mapped.values()) & set(mapped)


def test_packing(spark, table):
    docs = docs_of(spark, table)
    c = bpe.codec(*queries.tokenizer())
    got = STAGES["packing"](spark, docs, table).collect()
    check_bins(got, [(r.doc_id, tuple(c.encode(r.text))) for r in docs.collect()], (256, 512, 1024, 2048, 4096))


def test_run_and_an_empty_table(spark, table, tmp_path, monkeypatch):
    monkeypatch.setattr(toxicity, "STEPS", 120)
    ids = {d for r in corpus_pipeline.run(spark, table).collect() for d in r.doc_ids}
    assert ids and ids <= {r.doc_id for r in docs_of(spark, table).collect()}
    docs_of(spark, table).where(F.lit(False)).write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{table}/labels.parquet").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
