"""Nearest neighbours against brute force; the pipeline on a small corpus."""

import random
from pathlib import Path

import numpy as np

from zonedeck.llm import ann


def brute(x, ids, queries, k):
    out = {}
    for q in queries:
        i = int(np.flatnonzero(ids == q)[0])
        d = np.sqrt(((x - x[i]) ** 2).sum(axis=1))
        d[ids == q] = np.inf
        out[q] = [(int(ids[j]), float(d[j])) for j in np.lexsort((ids, d))[:k] if np.isfinite(d[j])]
    return out


def test_recall_and_exact_distances(spark):
    rng = np.random.default_rng(1)
    centres = rng.standard_normal((20, 24)) * 2
    x = (centres[rng.integers(0, 20, 3000)] + rng.standard_normal((3000, 24))).astype(np.float32)
    x[100:400] = x[100]  # a hot vector
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    odd = [(9000, None), (9100, [0.0] * 24), (9200, [float("nan")] + [1.0] * 23), (9300, [1.0, 2.0]), (9400, [None] + [1.0] * 23), (9500, [])]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>")
    got = {}
    for r in ann.nearest(df, df.filter("vec_id % 100 = 0")).collect():
        got.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    want = brute(x.astype(np.float64), np.arange(3000), range(0, 3000, 100), 10)
    assert set(got) == set(want)
    hits = 0
    for q, near in want.items():
        assert sorted(got[q]) == list(range(1, 11))
        found = [got[q][k] for k in range(1, 11)]
        assert found == sorted(found, key=lambda r: (r[1], r[0])) and q not in [v for v, _ in found]
        hits += len({v for v, _ in near} & {v for v, _ in found})
        for v, score in found:
            assert score == np.sqrt(((x[v].astype(np.float64) - x[q].astype(np.float64)) ** 2).sum())
    assert hits >= 0.9 * 10 * len(want)


def test_the_limit_tightens():
    """Later parts of a scan are judged by what earlier ones brought: fewer survive than under the first limit, and the nearest stay."""
    rng = np.random.default_rng(3)
    x, q = rng.standard_normal((3000, 32)), rng.standard_normal((1, 32))
    turn = ann.rotation(32)
    limits, kept = [], ann.surviving

    def seen(blocks, query, limit, dim):
        limits.append(limit)
        return kept(blocks, query, limit, dim)

    ann.surviving = seen
    try:
        _, rows, d = ann.scan(q, q @ turn, np.asarray([-1]), x, x @ turn, np.arange(3000), 10)
    finally:
        ann.surviving = kept
    assert len(limits) > 2 and all(a > b for a, b in zip(limits, limits[1:]))
    exact = np.sqrt(((x - q) ** 2).sum(axis=1))
    assert len(set(rows.tolist()) & set(np.argsort(exact)[:10].tolist())) >= 9
    assert np.allclose(d, exact[rows])


def test_few_and_no_vectors(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 1.0])], "vec_id long, embedding array<float>")
    assert [(r.vec_id, r.rank) for r in sorted(ann.nearest(df, df.filter("vec_id = 0")).collect(), key=lambda r: r.rank)] == [(1, 2), (2, 1)][::-1]
    assert ann.nearest(df.limit(0), df.limit(0)).count() == 0


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(400)]
    passage = " ".join(rng.choice(words) for _ in range(60))
    rows, labels = [], []
    for i in range(300):
        text = " ".join(rng.choice(words) for _ in range(rng.randint(5, 120)))
        if i % 10 == 0:
            text += " grotty scumbag"
        if i % 25 == 1:
            text = f"{text} {passage}"
        rows.append((i, text, "en", f"src{i % 4}", len(text)))
        labels.append((i, 1, int(i % 10 == 0)))
    rows += [(300 + k, rows[k][1], "en", "src0", rows[k][4]) for k in (3, 5, 7)] + [(400, "", "en", None, 0), (401, None, None, "src1", None)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash_near_dedup", "substring_dedup", "source_mixing", "best_fit_packing"]
    docs, names, kept = spark.read.parquet(str(tmp_path / "documents.parquet")), None, []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        if k < 4:
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / f"s{k}"))
        docs = spark.read.parquet(str(tmp_path / f"s{k}"))
        kept.append(docs)
    ids = [sorted({r.doc_id for r in d.select("doc_id").collect()}) for d in kept]
    toxic = {i for i in range(300) if i % 10 == 0}
    assert len(toxic & set(ids[0])) <= 6 and len(set(range(300)) - toxic - set(ids[0])) <= 10  # clean ones stay
    assert not {303, 305, 307} & set(ids[1]) and {3, 5, 7} <= set(ids[1])
    assert sum(passage in (r.text or "") for r in kept[2].collect()) == 1
    assert {r.doc_id for r in kept[4].collect()} == {r.doc_id for r in kept[3].collect()}
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == kept[4].count()
    from urllib.parse import urlparse

    from zonedeck.llm import common

    assert not list(Path(urlparse(common.shared_folder(spark)).path).glob("pipeline-*"))  # nothing stays behind
    against_brute_force(spark, [spark.read.parquet(str(tmp_path / "documents.parquet")), *kept], tmp_path)


def against_brute_force(spark, tables, tmp_path):
    """Each stage's rows from those of the one before, by plain loops, the mix by its SQL and the pieces by the tokenizer."""
    import re
    import zlib

    import duckdb
    from tokenizers import Tokenizer

    from zonedeck.llm import mixing, packing, toxicity

    word = re.compile(r"[^\x20\x09-\x0D]+")
    rows = [sorted(((r.doc_id, r.text) for r in t.select("doc_id", "text").collect()), key=str) for t in tables[:5]]
    scores = {r.doc_id: r.score for r in toxicity.toxicity_scores(tables[0], spark.read.parquet(str(tmp_path / "labels.parquet"))).collect()}
    assert rows[1] == [r for r in rows[0] if scores[r[0]] < 0.3]

    def shingles(text):
        words = word.findall((text or "").lower())
        return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()

    sets, first = {i: shingles(t) for i, t in rows[1]}, {}
    for i in sorted(sets):
        alike = [j for j in sorted(sets) if j < i and (sets[i] == sets[j] or len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]))]
        first[i] = min([first[j] for j in alike], default=i)
    assert rows[2] == [r for r in rows[1] if first[r[0]] == r[0]]

    seen, want = set(), []
    for i, text in sorted(rows[2]):
        words, gone = word.findall(text or ""), set()
        for s in range(len(words) - 19):
            w = tuple(words[s : s + 20])
            if w in seen:
                gone.update(range(s, s + 20))
            seen.add(w)
        want.append((i, " ".join(w for k, w in enumerate(words) if k not in gone) if gone else text or ""))
    assert [(i, t or "") for i, t in rows[3]] == sorted(want, key=str)

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/s2/*.parquet'")
    taken = {r[0]: (r[4], r[1]) for r in con.execute(f"SELECT doc_id, size, source_size, target, taken FROM ({mixing.ORACLE})").fetchall()}
    counts = {i: sum(1 for r in rows[4] if r[0] == i) for i in taken}
    assert all(counts[i] * size == words for i, (words, size) in taken.items())

    tokenizer = Tokenizer.from_file(packing.default_tokenizer())
    pieces = []
    for _, text in rows[4]:
        ids = np.asarray([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        cuts = [0, *range(len(ids) % 2048 or min(len(ids), 2048), len(ids) + 1, 2048)]
        pieces += [(b - a, zlib.crc32(ids[a:b].tobytes())) for a, b in zip(cuts, cuts[1:])]
    packed = tables[5].collect()
    assert sorted((r.length, r.ids_crc32) for r in packed) == sorted(pieces)
    sequences = {}
    for r in packed:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        assert [sum(n for _, n in sorted(parts)[:k]) for k in range(len(parts))] == [o for o, _ in sorted(parts)] and sum(n for _, n in parts) <= 2048
    total = sum(n for n, _ in pieces)
    assert -(-total // 2048) <= len(sequences) <= 1.1 * total / 2048 + 1
