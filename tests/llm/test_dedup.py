"""SimHash, fingerprints and substring dedup against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from zonedeck.llm import fingerprints, simhash_dedup, substring_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def corpus(seed=3, n=60):
    rng = random.Random(seed)
    words = ["the", "of", "and", "Ünï", "a", "zeta"] + [f"w{i}" for i in range(40)]
    passage = " ".join(rng.choice(words) for _ in range(35))
    texts = []
    for i in range(n):
        text = [rng.choice(words) for _ in range(rng.choice([0, 1, 2, 5, 19, 20, 21, 60, 150]))]
        if i % 4 == 0:
            at = rng.randint(0, len(text))
            text[at:at] = passage.split()
        if i % 7 == 0:
            text += ["go"] * rng.randint(15, 45)
        texts.append(rng.choice([" ", "\n", "\t "]).join(text))
    texts += [texts[5], texts[8], texts[8], None, "", " \t", "x" * 3000, " ".join(["ab", "cd"] * 500)]
    return list(enumerate(texts))


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], DOCS)


def brute_fingerprint(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(prints, radius=2):
    label = {i: i for i, _ in prints}
    changed = True
    while changed:
        changed = False
        for i, a in prints:
            for j, b in prints:
                if (a ^ b).bit_count() <= radius and label[i] != label[j]:
                    label[i] = label[j] = min(label[i], label[j])
                    changed = True
    return label


def test_simhash_classes(spark):
    rows = corpus()
    got = simhash_dedup.near_duplicate_classes(frame(spark, rows).select("doc_id", "text")).collect()
    want = [(i, brute_fingerprint(t)) for i, t in rows]
    assert {r.doc_id: r.fp % 2**64 for r in got} == dict(want)
    assert {r.doc_id: r.component_id for r in got} == brute_components(want)


@pytest.mark.parametrize("chunk", [4, 1024])
def test_links_of_a_crowded_neighbourhood(spark, chunk):
    """Many prints within few bits, over several chunks, and a chain: all in the right components."""
    rng = random.Random(1)
    base = rng.getrandbits(64)
    prints = [base ^ (1 << rng.randrange(64)) for _ in range(40)] + [rng.getrandbits(64) for _ in range(60)]
    chain = [rng.getrandbits(64)]
    for k in range(12):
        chain.append(chain[-1] ^ (0b11 << 2 * k))
    rows = list(enumerate(dict.fromkeys(prints + chain)))
    df = spark.createDataFrame([(i, x - 2**64 if x >= 2**63 else x) for i, x in rows], "node long, fp long")
    links = simhash_dedup.link_classes(df, chunk=chunk)
    got = {r.node: r.component for r in simhash_dedup.components(links).collect()}
    assert {i: got.get(i, i) for i, _ in rows} == brute_components(rows)


def test_one_document_of_each_group_stays(spark):
    rows = corpus()
    kept = simhash_dedup.without_near_duplicates(frame(spark, [*rows, (None, "null id")]))
    label = brute_components([(i, brute_fingerprint(t)) for i, t in rows])
    assert sorted(r.doc_id for r in kept.filter("doc_id IS NOT NULL").collect()) == sorted(set(label.values()))
    assert kept.filter("doc_id IS NULL").count() == 1


def brute_kept(rows, window=20):
    docs = [(i, WORD.findall(t or "")) for i, t in sorted(rows)]
    seen, out = set(), {}
    for i, words in docs:
        gone = set()
        for s in range(len(words) - window + 1):
            w = tuple(words[s : s + window])
            if w in seen:
                gone.update(range(s, s + window))
            seen.add(w)
        out[i] = (len(words), len(gone), [w for k, w in enumerate(words) if k not in gone])
    return out


@pytest.mark.parametrize("seed", [3, 4, 5])
def test_repeated_windows_go(spark, seed):
    rows = corpus(seed, 90)
    df = frame(spark, rows).withColumns({"_starts": F.lit("mine"), "kept_text": F.lit(1), "packed": F.lit(2)})
    got = {r.doc_id: r for r in substring_dedup.dedup_substrings(df.select("doc_id", "text", "packed", "kept_text")).collect()}
    for i, (n, gone, kept) in brute_kept(rows).items():
        assert (got[i].n_words, got[i].n_removed, WORD.findall(got[i].kept_text)) == (n, gone, kept), i


def test_equal_ids_do_not_remove_each_other(spark):
    text = " ".join(f"u{i}" for i in range(50))
    got = substring_dedup.dedup_substrings(spark.createDataFrame([(1, text), (1, text)], "doc_id long, text string")).collect()
    assert [r.n_removed for r in got] == [0, 0]


def brute_by_row(rows, window=20):
    """Removed words of each row: an equal window has a smaller id, or an earlier start in the row itself; null ids come first and are one id."""
    docs = [(-(2**63) if i is None else i, WORD.findall(t or "")) for i, t in rows]
    least = {}
    for i, words in docs:
        for s in range(len(words) - window + 1):
            w = tuple(words[s : s + window])
            least[w] = min(least.get(w, i), i)
    out = []
    for i, words in docs:
        gone, own = set(), set()
        for s in range(len(words) - window + 1):
            w = tuple(words[s : s + window])
            if least[w] < i or w in own:
                gone.update(range(s, s + window))
            own.add(w)
        out.append((i, " ".join(words), len(gone)))
    return sorted(out)


@pytest.mark.parametrize("batch", [3, 10_000])
def test_rows_that_share_an_id_keep_what_is_theirs(spark, batch):
    """(0, A), (1, A), (1, Z): Z stays whole; so do other texts of an id or of none that has a copy or a passage."""
    rng = random.Random(4)
    some = lambda n: " ".join(f"k{rng.randrange(10**6)}" for _ in range(n))
    a, z, passage = some(50), some(60), some(30)
    rows = [(0, a), (1, a), (1, z), (1, z), (1, f"{some(10)} {passage} {some(5)}"), (1, some(60)), (2, f"{passage} {some(9)} {passage}")]
    rows += [(None, a), (None, f"{passage} {passage}"), (None, some(40)), (7, None), (7, ""), (7, some(25))]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got = substring_dedup.dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = brute_by_row(rows)
    assert (1, z, 0) in want
    assert sorted((-(2**63) if r.doc_id is None else r.doc_id, " ".join(WORD.findall(r.text or "")), r.n_removed) for r in got) == want


@pytest.mark.parametrize("seed", [1, 2])
def test_repeated_ids_against_brute_force(spark, seed):
    rng = random.Random(seed)
    rows = [(rng.choice([None, *range(25)]), t) for _, t in corpus(seed, 90)]
    rows += rows[:10]
    got = substring_dedup.dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    assert sorted((-(2**63) if r.doc_id is None else r.doc_id, " ".join(WORD.findall(r.text or "")), r.n_removed) for r in got) == brute_by_row(rows)


def test_anchors_depend_on_the_window_alone():
    """Equal windows of different surroundings have equal anchors at equal places."""
    rng = random.Random(9)
    passage = [f"p{rng.randrange(6)}" for _ in range(60)]
    texts = []
    for _ in range(8):
        side = lambda: [f"p{rng.randrange(6)}" for _ in range(rng.randrange(40))]
        texts.append(" ".join(side() + passage + side()).encode())
    s = substring_dedup.Slice(texts)
    start, name, place = substring_dedup.anchors(s)
    seen = {}
    flat = [w for ws in s.words for w in ws]
    for a, n, p in zip(start.tolist(), name.tolist(), place.tolist()):
        assert a <= p <= a + substring_dedup.WINDOW - substring_dedup.CONTEXT
        assert seen.setdefault(tuple(flat[a : a + 20]), (n, p - a)) == (n, p - a)


def test_fingerprints_of_edited_texts(spark):
    rows = [(i * 3, t) for i, t in corpus()]
    got = {r.doc_id: r for r in fingerprints.edited_fingerprints(frame(spark, rows)).collect()}
    texts = [t or "" for _, t in rows]
    for k, (i, _) in enumerate(rows):
        text, following = texts[k], texts[(k + 1) % len(texts)]
        q = len(text) // 4
        edited = text[: len(text) - q] + following[:q]
        assert (got[i].n_chars, got[i].edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert got[i].next_fp == got[rows[(k + 1) % len(rows)][0]].fp
    same = {}
    for k, (i, _) in enumerate(rows):
        assert same.setdefault(texts[k], got[i].fp) == got[i].fp
    assert got[rows[[t for _, t in rows].index("")][0]].fp == 0


@pytest.mark.parametrize("range_rows", [1, 7, 10_000])
def test_next_documents_of_odd_ids(spark, monkeypatch, range_rows):
    """Far ids, missing and repeated ones, equal rows; whatever the ranges."""
    monkeypatch.setattr(fingerprints, "RANGE_ROWS", range_rows)
    rng = random.Random(range_rows)
    some = lambda: " ".join(rng.choice("abcdefg") for _ in range(rng.randint(0, 30)))
    rows = [(i, some()) for i in range(40)] + [(10**15, some()), (-5, some()), (None, some()), (None, some()), (3, "another text"), (7, None), (7, None)]
    rows += [rows[4]] * 3
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    hashes = {(r.doc_id, r.t): r.h for r in df.select("doc_id", F.coalesce("text", F.lit("")).alias("t")).withColumn("h", F.xxhash64("t")).collect()}
    texts = sorted(hashes, key=lambda x: (-(2**63) if x[0] is None else x[0], hashes[x]))
    want = {}
    for k, (i, text) in enumerate(texts):
        q = len(text) // 4
        want[i, text] = hashlib.sha256((text[: len(text) - q] + texts[(k + 1) % len(texts)][1][:q]).encode()).hexdigest()
    got = fingerprints.edited_fingerprints(df).collect()
    full = [(i, t or "") for i, t in rows]
    assert sorted(((r.doc_id, r.n_chars, r.edited_sha256) for r in got), key=lambda x: (x[0] is not None, x[0] or 0, x[1:])) == sorted(((i, len(t), want[i, t]) for i, t in full), key=lambda x: (x[0] is not None, x[0] or 0, x[1:]))


def test_near_prints_are_counted(spark):
    rng = random.Random(4)
    base = [rng.getrandbits(64) for _ in range(30)]
    prints = [b ^ sum(1 << x for x in rng.sample(range(64), rng.randint(0, 5))) for b in base for _ in range(10)] + base[:3] * 2
    signed = [x - 2**64 if x >= 2**63 else x for x in prints]
    rows = [(i if i % 31 else None, x) for i, x in enumerate(signed)]
    got = fingerprints.with_near_prints(spark.createDataFrame(rows, "doc_id long, fp long")).collect()
    assert len(got) == len(rows)
    for r in got:
        want = sum(0 < (x ^ r.fp % 2**64).bit_count() <= 3 for x in set(prints))
        assert r.near_prints == (want if r.doc_id is not None and r.doc_id % 20 == 0 else None)
    assert sum(r.near_prints or 0 for r in got) > 20


def test_votes_against_brute_force(spark):
    text = "alpha beta Gamma beta alpha beta verylongwordindeed x"
    words = text.split()
    df = spark.createDataFrame([(1, text)], "k int, text string")
    pairs = [(a, b) for a, b in zip(words, [*words[1:], None])]
    hashes = spark.createDataFrame(pairs, "a string, b string").select(F.xxhash64("a", "b")).collect()
    votes = [0] * 64
    for (a, b), (h,) in zip(pairs, hashes):
        w = min(16, len(a) + len(b or ""))
        for bit in range(64):
            votes[bit] += w if (h % 2**64) >> bit & 1 else -w
    got = fingerprints.fingerprint_rows(df, ["k"]).first().fp
    assert got % 2**64 == sum(1 << bit for bit in range(64) if votes[bit] > 0)


def test_block_tables_find_all_within_the_radius(spark):
    rng = np.random.default_rng(2)
    x = rng.integers(-(2**63), 2**63, 200)
    x = np.r_[x, x[:50] ^ (1 << rng.integers(0, 63, 50)), x[:20] ^ 7, x[:5]]
    df = spark.createDataFrame([(int(v),) for v in x], "fp long")
    got = {(r.query_fp, r.fp): r.distance for r in fingerprints.within_radius(df.limit(60), df).collect()}
    distinct = {int(v) for v in x}
    want = {(a, b): bin((a ^ b) % 2**64).count("1") for a in {int(v) for v in x[:60]} for b in distinct}
    assert got == {k: v for k, v in want.items() if v <= 3}


def test_empty_tables(spark):
    none = frame(spark, [])
    assert simhash_dedup.near_duplicate_classes(none.select("doc_id", "text")).count() == 0
    assert substring_dedup.dedup_substrings(none).count() == 0
    assert fingerprints.edited_fingerprints(none).count() == 0


def test_near_copies_are_found_and_verified(spark):
    """Edited copies with a 5-word Jaccard similarity of 0.8 or more go; those below it and unrelated texts of a shared id stay."""
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(2000)]

    def shingles(t):
        w = t.lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}

    rows, copies, others = [], set(), set()
    for i in range(150):
        base = [rng.choice(words) for _ in range(rng.randint(60, 250))]
        rows.append((i, " ".join(base)))
        edited = list(base)
        for k in rng.sample(range(len(base)), max(1, len(base) * rng.randint(1, 5) // 100)):
            edited[k] = rng.choice(words)
        a, b = shingles(" ".join(base)), shingles(" ".join(edited))
        (copies if len(a & b) >= 0.8 * len(a | b) else others).add(1000 + i)
        rows.append((1000 + i, " ".join(edited)))
    assert len(copies) > 50 and len(others) > 10
    rows += [(1003, "an unrelated text " + " ".join(rng.choice(words) for _ in range(40))), (None, rows[0][1]), (2000, ""), (2001, None)]
    out = simhash_dedup.without_near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    ids = {r.doc_id for r in out}
    assert not ids & copies - {1003} and others <= ids and set(range(150)) <= ids
    assert sum(r.doc_id is None for r in out) == 1 and ids & {2000, 2001} == {2000}
    assert [r.text[:17] for r in out if r.doc_id == 1003][-1] == "an unrelated text"


def test_a_crowd_of_near_copies_is_one(spark):
    """Copies that differ from each other as well, in a bucket of several chunks."""
    rng = random.Random(9)
    base = [f"w{k}" for k in range(200)]
    rows = []
    for i in range(2500):
        text = list(base)
        for k in rng.sample(range(200), 2):
            text[k] = f"x{i}"
        rows.append((i, " ".join(text)))
    assert simhash_dedup.without_near_copies(spark.createDataFrame(rows, "doc_id long, text string")).count() == 1
