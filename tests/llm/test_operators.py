import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def corpus(seed: int = 3, n: int = 120) -> list[str | None]:
    """Texts with copies, near copies, shared passages, periods, nulls, empties, white space and one long text."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcde") for _ in range(r.randint(1, 6)))
    passage = " ".join(word() for _ in range(60))
    out: list[str | None] = []
    for k in range(n):
        t = [word() for _ in range(r.choice([0, 1, 3, 4, 25, 60, 200]))]
        if k % 7 == 0:
            t[len(t) // 2 : len(t) // 2] = passage.split()
        if k % 11 == 0 and len(out) > 3 and out[-3]:
            t = out[-3].split()
            if k % 2 and len(t) > 30:
                t[5] = "zz"
        out.append(" ".join(t))
    return out + [None, "", " \n\t", "one", "Ab ab " * 40, "x" * 5000, " ".join(word() for _ in range(20000)), "été\u00a0\x1cÀ <|endoftext|> it's"]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(k, t, "en", "s", len(t or "")) for k, t in enumerate(corpus())], DOCS).repartition(5)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], DOCS)


def texts(docs):
    return {r.doc_id: r.text for r in docs.collect()}


def test_substring_dedup(docs, nothing):
    from quarrylane.llm.substring_dedup import digest_rows

    words = {k: (t or "").encode().split() for k, t in texts(docs).items()}
    seen, gone = set(), {k: set() for k in words}
    for k in sorted(words):
        for i in range(len(words[k]) - 19):
            w = tuple(words[k][i : i + 20])
            if w in seen:
                gone[k] |= set(range(i, i + 20))
            seen.add(w)
    want = {k: (len(w), len(gone[k]), hashlib.sha256(b" ".join(x for i, x in enumerate(w) if i not in gone[k])).hexdigest()) for k, w in words.items()}
    assert {r.doc_id: tuple(r)[1:] for r in digest_rows(docs).collect()} == want
    assert digest_rows(nothing).count() == 0


def test_substring_dedup_repeated_rows(spark):
    from quarrylane.llm.substring_dedup import remove_repeats

    r = random.Random(4)
    text = lambda n: " ".join(f"w{r.randrange(10**6)}" for _ in range(n))
    one, two = text(40), text(40)
    first, null, other = f"{text(30)} {one} {text(30)}", f"{two} {text(9)}", text(25)
    rows = [(1, first), (1, first), (None, null), (None, null), (2, f"{other} {one} {two}")]
    got = remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), with_text=True).collect()
    assert sorted((d.doc_id or 0, d.n_removed, d.text) for d in got) == sorted([(0, 0, null)] * 2 + [(1, 0, first)] * 2 + [(2, 80, other)])


def test_jaccard(docs, nothing):
    from quarrylane.llm.jaccard import jaccard_components

    sets = {}
    for k, t in texts(docs).items():
        w = (t or "").encode().lower().split()
        sets[k] = {tuple(w[i : i + 4]) for i in range(len(w) - 3)} if len(w) > 3 else {tuple(w)} if w else set()
    root = {k: k for k in sets}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_components(docs).collect()} == {k: (len(s), find(k)) for k, s in sets.items()}
    assert jaccard_components(nothing).count() == 0


def test_jaccard_null_bridge_and_few_words(spark):
    from quarrylane.llm.jaccard import jaccard_components

    words = [f"w{k}" for k in range(110)]
    a, b, c = (" ".join(words[k : k + 90]) for k in (0, 10, 20))  # a - b and b - c are links at 75, a - c is none
    for bridge, want in (([(None, b)], {(1, 1), (2, 1), (None, 1)}), ([], {(1, 1), (2, 2)})):
        df = spark.createDataFrame([(1, a), (2, c), *bridge], "doc_id long, text string")
        assert {(r.doc_id, r.component_id) for r in jaccard_components(df, percent=75).collect()} == want
    few = spark.createDataFrame([(5, "just three words")], "doc_id long, text string")
    assert [tuple(r) for r in jaccard_components(few, n=5).collect()] == [(5, 1, 5)]


def test_jaccard_hot_signatures(spark, monkeypatch):
    """One passage in every document, sets of several components: signatures of over BLOCK classes are dealt to a grid of cells."""
    from quarrylane.llm import jaccard as J

    r = random.Random(7)
    common = [f"c{k}" for k in range(60)]
    rows = []
    for family in range(6):
        base = common + [f"f{family}x{k}" for k in range(50)]
        for copy in range(12):
            w = list(base)
            for _ in range(r.randrange(4)):
                w[r.randrange(60, len(w))] = f"r{r.randrange(10**6)}"
            rows.append((len(rows), " ".join(w)))
    sets = {k: {tuple(t.split()[i : i + 4]) for i in range(len(t.split()) - 3)} for k, t in rows}
    root = {k: k for k in sets}
    links = [(a, b) for a in sets for b in sets if a != b and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    for _ in sets:  # labels spread along links
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    df = spark.createDataFrame(rows, "doc_id long, text string")
    dealt, deal = [], J._dealt

    def watched(signed, scratch):
        out = deal(signed, scratch)
        dealt.append((signed.count(), out.count(), out.groupBy("sig").count().agg({"count": "max"}).first()[0]))
        return out

    monkeypatch.setattr(J, "_dealt", watched)
    for block in (20_000, 8):
        monkeypatch.setattr(J, "BLOCK", block)
        assert {d.doc_id: d.component_id for d in J.jaccard_components(df).collect()} == root
    (rows_in, rows_out, most), (small_in, small_out, small_most) = dealt
    assert rows_in == rows_out == small_in < small_out and small_most < most


def test_pair_signatures_lose_nothing():
    from quarrylane.llm import jaccard as J

    rng = np.random.default_rng(1)
    often = np.ones(1 << J.SLOTS, dtype=bool)  # every shingle is frequent: only pairs stand in the index
    for size in (70, 120, 127, 128, 300, 600):
        for _ in range(20):
            base = np.unique(rng.integers(0, 2**63, size, dtype=np.uint64))
            drop = int(len(base) * 0.15)
            other = base[rng.permutation(len(base))[drop:]]
            assert len(np.intersect1d(J.signatures(base, often, 85), J.signatures(np.sort(other), often, 85)))


def test_language_model(docs, nothing):
    from quarrylane.llm.lm_maxent import score_documents

    tokens = {k: (t or "").encode().lower().split() + [None] for k, t in texts(docs).items()}
    count = Counter(w for k, t in tokens.items() if zlib.crc32(str(k).encode()) % 7 != 2 for w in t)
    n, v = sum(count.values()), len(count)
    rows = score_documents(docs).collect()
    assert len(rows) == len(tokens)
    for r in rows:
        t = tokens[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(t), sum(count[w] > 0 for w in t), n)
        assert math.isclose(r.base_score, sum(math.log10((count[w] + 1) / (n + v + 1)) for w in t), rel_tol=1e-9, abs_tol=1e-9) and math.isfinite(r.score) and r.score < 0
    assert score_documents(nothing).count() == 0


def test_language_model_clusters_see_all_rows(spark, monkeypatch):
    from quarrylane.llm import lm_maxent

    r = random.Random(2)
    rows = [(k, " ".join(r.choices("abcdefgh", k=10_000)), "", "", 0) for k in range(400)]
    asked, summed = [], lm_maxent._summed
    monkeypatch.setattr(lm_maxent, "_summed", lambda x: asked.append(x) or summed(x))
    train = lm_maxent.score_documents(spark.createDataFrame(rows, DOCS)).first().train_tokens
    assert sum(int(np.frombuffer(zlib.decompress(b.blob), np.int64).sum()) for b in asked[0].collect()) == train > 3_000_000


def test_language_model_knows_pairs_of_rare_words(spark, monkeypatch):
    from quarrylane.llm import lm_maxent

    monkeypatch.setattr(lm_maxent, "CHUNK_BYTES", 20_000)
    r = random.Random(6)
    held = [k for k in range(3000) if zlib.crc32(str(k).encode()) % 7 == 2][:2]
    phrase = [f"w{r.randrange(3000)}" for _ in range(30)]
    rows = [(k, " ".join([f"w{r.randrange(3000)}" for _ in range(60)] + phrase * (k % 50 == 0))) for k in range(600) if k not in held]
    rows += [(held[0], " ".join(phrase)), (held[1], " ".join(r.sample(phrase, 30)))]
    got = {d.doc_id: d for d in lm_maxent.score_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    known, mixed = (got[k] for k in held)
    assert math.isclose(known.base_score, mixed.base_score) and known.held_out and mixed.held_out
    assert known.score > mixed.score + 20 and mixed.score > mixed.base_score - 10  # the same words, in an order that was learnt and in one that wasn't


def test_n_grams_of_all_training_rows_are_counted(docs):
    from quarrylane.llm import lm_maxent
    from quarrylane.llm.common import Scratch

    rows = docs.selectExpr("doc_id", "text", "doc_id % 3 = 0 AS held_out")
    tokens = [[None, None, *(t or "").encode().lower().split(), None] for k, t in texts(docs).items() if k % 3]
    want = Counter(), Counter()
    for t in tokens:
        want[0].update(zip(t[1:], t[2:]))
        want[1].update(zip(t, t[2:]))
    met = lm_maxent.n_grams_met(lm_maxent._chunks(rows, Scratch(docs.sparkSession, "test")), 10**6).filter("chunk < 0").groupBy().sum("pairs", "skips").first()
    assert tuple(met) == tuple(sum(n == 1 for n in w.values()) for w in want)


def test_packing_and_bpe(docs, nothing):
    from tokenizers import Tokenizer

    from quarrylane.llm.bpe import decode, default_vocabulary, encode, encode_digests
    from quarrylane.llm.packing import pack

    library = Tokenizer.from_file(default_vocabulary())
    ids = {k: library.encode(t or "", add_special_tokens=False).ids for k, t in texts(docs).items()}
    for k, t in texts(docs).items():
        assert encode(t) == ids[k] and decode(ids[k]) == library.decode(ids[k], skip_special_tokens=False)
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert {tuple(r) for r in encode_digests(docs).collect()} == {(k, len(i), digest(" ".join(map(str, i))), digest(library.decode(i, skip_special_tokens=False))) for k, i in ids.items()}
    pieces = pack(docs, window=64).collect()
    place = 0
    for p in sorted(pieces, key=lambda p: (p.sequence_id, p.offset)):
        assert p.sequence_id * 64 + p.offset == place and p.offset + p.length <= 64
        whole = [*ids[p.doc_id], 2]
        assert p.doc_tokens == len(whole) and p.ids_crc32 == zlib.crc32(np.array(whole[p.start : p.start + p.length], dtype="<u4").tobytes())
        place += p.length
    assert place == sum(len(i) + 1 for i in ids.values()) and pack(nothing).count() == 0 and encode_digests(nothing).count() == 0


def test_packing_of_special_tokens_in_other_case(spark):
    from tokenizers import Tokenizer

    from quarrylane.llm.bpe import default_vocabulary
    from quarrylane.llm.packing import pack

    library = Tokenizer.from_file(default_vocabulary())
    rows = list(enumerate(["a <|ENDOFTEXT|> b", "<|StartOfText|>", "x<|endoftext|>.", "Ab<|EndOfText|>, C", "<|endoftext|>", "<|STARTOFTEXT|>Word."]))
    got = {p.doc_id: (p.doc_tokens, p.ids_crc32) for p in pack(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()}
    want = {k: [*library.encode(t, add_special_tokens=False).ids, 2] for k, t in rows}
    assert got == {k: (len(i), zlib.crc32(np.array(i, dtype="<u4").tobytes())) for k, i in want.items()}


def test_sharding(spark, nothing):
    from quarrylane.llm.sharding import shard_documents

    rows = [(k, "same text of a third" if k % 3 == 0 else f"text {k}" * (k % 9), "", "", 0) for k in range(3000)] + [(None, None, "", "", 0), (7, "x", "", "", 0)]
    got = shard_documents(spark.createDataFrame(rows, DOCS)).toPandas()
    sizes, mean = got.groupby("shard")["size"].sum(), got["size"].sum() / 24
    assert len(got) == len(rows) and len(sizes) == 24 and (abs(sizes - mean) < 0.05 * mean).all()
    assert all(sorted(g) == list(range(len(g))) for _, g in got.groupby("shard")["slot"]) and shard_documents(nothing).count() == 0


def test_searches(spark):
    from quarrylane.llm.ann_blocks import nearest
    from quarrylane.llm.topk_voronoi import top_k

    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, 8)).astype(np.float32)
    x[100:220] = x[100]
    rows = [(k, v.tolist()) for k, v in enumerate(x)] + [(1000, None), (1050, [float("nan")] * 8), (1100, [None] * 8), (None, [1.0] * 8), (2000, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    for got, every, k, m in ((top_k(df), 50, 5, np.floor(256 * x.astype(np.float64))), (nearest(df, data_block=64, query_block=8), 20, 20, x.astype(np.float64))):
        found = {}
        for r in got.collect():
            found.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
        assert set(found) == set(range(0, 400, every))
        for q, rows_ in found.items():
            s = [(-math.fsum(m[q] * m[c]), c) for c in range(400) if c != q]
            assert [(a, b, float(c)) for a, b, c in sorted(rows_)] == [(n + 1, c, -v) for n, (v, c) in enumerate(sorted(s)[:k])]
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert top_k(empty).count() == 0 and nearest(empty).count() == 0


def test_voronoi_prunes_clusters_and_keeps_answers(spark):
    from quarrylane.llm import topk_voronoi

    rng = np.random.default_rng(3)
    heads = rng.normal(size=(8, 16)) * 20
    x = (heads[rng.integers(0, 8, 1500)] + rng.normal(size=(1500, 16)) * 0.1).astype(np.float32)
    rows = [(k, v.tolist()) for k, v in enumerate(x)] + [(5000, [1e308] * 16), (5050, [1e12] * 16)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    kept, summaries = [], topk_voronoi._summaries
    topk_voronoi._summaries = lambda *a: kept.append(summaries(*a)) or kept[-1]
    try:
        got = topk_voronoi.top_k(df, cell_rows=100, group_queries=4).collect()
    finally:
        topk_voronoi._summaries = summaries
    m, found = np.floor(256 * x.astype(np.float64)), {}
    for r in got:
        found.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    for q in range(0, 1500, 50):
        best = sorted((-int(s), c) for c, s in enumerate(m @ m[q]) if c != q)[:5]
        assert sorted(found[q]) == [(n + 1, c, -v) for n, (v, c) in enumerate(best)]
    assert set(found) == set(range(0, 1500, 50)) and kept[0][16].needed.mean() < 0.5


def test_searches_with_repeated_queries(spark):
    from quarrylane.llm.ann_blocks import nearest
    from quarrylane.llm.topk_voronoi import top_k

    x = np.random.default_rng(8).normal(size=(60, 4)).astype(np.float32)
    x[50:58] = x[0]
    ids = [*range(60), 0, 0, 50, *[7] * 9, *[20] * 3]
    df = spark.createDataFrame([(k, x[k].tolist()) for k in ids], "vec_id long, embedding array<float>").repartition(3)
    whole, found = np.floor(256 * x.astype(np.float64)), {}
    for r in top_k(df).collect():
        found.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    for q in (0, 50):  # as the SQL: every pair of rows
        pairs = sorted((-int(whole[q] @ whole[c]), c) for a in ids if a == q for c in ids if c != q)[:5]
        assert sorted(found[q]) == [(n + 1, c, -v) for n, (v, c) in enumerate(pairs)]
    assert set(found) == {0, 50}
    close = {}
    for r in nearest(df, data_block=16, query_block=2).collect():
        close.setdefault(r.query_id, []).append((r["rank"], r.vec_id))
    for q in (0, 20, 40):
        rows = sorted((-math.fsum(x[q].astype(np.float64) * x[c].astype(np.float64)), c) for c in ids if c != q)[:20]
        assert sorted(close[q]) == [(n + 1, c) for n, (_, c) in enumerate(rows)]


def test_classifiers(spark, nothing):
    from quarrylane.llm import quality, toxicity

    r = random.Random(1)
    rows, labels = [], []
    for k in range(400):
        bad, toxic = k % 4 == 0, k % 5 == 0
        words = ["".join(r.choice("aeioutns") for _ in range(4)) for _ in range(50)]
        if toxic:
            words[3:3] = ["idiot", "scum"][: 1 + k % 2]
        rows.append((k, " ".join(w + "&&&" if bad else w for w in words), "", "", 0))
        labels.append((k, int(not bad), int(toxic)))
    df = spark.createDataFrame(rows + [(900, None, "", "", 0), (901, "", "", "", 0)], DOCS)
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    scored = {r.doc_id: r for r in quality.classify(df, marks).collect()}
    assert len(scored) == 402 and all(0 <= s.score <= 1 and s.predicted == int(s.score >= 0.3) for s in scored.values())
    assert np.mean([scored[k].predicted == q for k, q, _ in labels if scored[k].held_out]) > 0.95
    graded = {r.doc_id: r for r in toxicity.grade_documents(df, marks).collect()}
    assert np.mean([graded[k].toxic == bool(t) for k, _, t in labels]) > 0.97 and not graded[900].toxic
    none = marks.limit(0)
    assert quality.classify(df, none).count() == 402 and toxicity.grade_documents(df, none).count() == 402
    assert quality.classify(nothing, marks).count() == 0 and toxicity.grade_documents(nothing, marks).count() == 0


def test_pipeline(spark):
    import corpus_pipeline

    sf, docs = "/root/testdata/sf0.001", None
    docs = start = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, sf).collect(), start.schema)
        assert docs.columns == start.columns
    assert 0 < docs.count() < start.count()
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert {r.doc_id for r in pieces.collect()} == {r.doc_id for r in docs.collect()}


CLASHES = ["y", "_id", "score", "predicted", "severity", "toxic", "_text", "_key", "rep", "spans", "row", "id", "key", "within", "bucket", "first", "part", "chunk", "sig", "cls", "own", "n"]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty texts, repeated rows, ids with two texts, a long word, and columns named like internal ones."""
    long = " ".join(f"w{k % 700}" for k in range(30_000))
    rows = [(1, "a b c d e f g"), (1, "a b c d e f g"), (2, None), (None, "q " * 30), (None, None), (3, ""), (4, long), (5, long), (5, "other text here"), (6, "x" * 200_000)]
    return spark.createDataFrame([(*r, "en", "s", len(r[1] or ""), *range(len(CLASHES))) for r in rows], DOCS + "".join(f", {c} int" for c in CLASHES)).repartition(3)


def test_operators_take_odd_rows_and_clashing_columns(spark, odd):
    from pyspark.sql import functions as F

    from quarrylane.llm import bpe, jaccard, lm_maxent, packing, quality, sharding, substring_dedup, toxicity

    labels = spark.createDataFrame([(1, 1, 0), (4, 0, 1), (5, 1, 1), (3, 1, 0)], "doc_id long, quality int, toxic int").withColumns({"text": F.lit("x"), "y": F.lit(9)})
    total = odd.count()
    for run in (
        lambda d: quality.classify(d, labels), lambda d: toxicity.grade_documents(d, labels), substring_dedup.digest_rows, lm_maxent.score_documents, bpe.encode_digests, sharding.shard_documents, jaccard.jaccard_components,
    ):
        assert run(odd).count() == total and run(odd.limit(0)).count() == 0
    assert packing.pack(odd).select("doc_id").distinct().count() == 7
    scored = quality.score_documents(odd, quality.fit(odd, labels))
    assert set(odd.columns) <= set(scored.columns) and scored.count() == total
    cleaned = substring_dedup.remove_repeats(odd, with_text=True)
    assert [r.rep for r in cleaned.collect()] == [CLASHES.index("rep")] * total and set(odd.columns) <= set(cleaned.columns)
    placed = sharding.assign_shards(odd, F.length("text"), F.xxhash64("text"), "doc_id", 2)
    assert {(r["id"], r["first"]) for r in placed.collect()} == {(CLASHES.index("id"), CLASHES.index("first"))}


def test_quality_is_ridge_on_its_features(spark):
    from quarrylane.llm import quality

    r = random.Random(5)
    rows = [(k, " ".join("".join(r.choice("abcd#&") for _ in range(r.randint(1, 9))) for _ in range(r.randint(1, 60)))) for k in range(300)]
    label = {k: int(t.count("&") * 6 < len(t) * 0.9) for k, t in rows}
    docs = spark.createDataFrame(rows + rows[:40], "doc_id long, text string").repartition(4)  # repeated documents count once
    model = quality.fit(docs, spark.createDataFrame([(k, y) for k, y in label.items()], "doc_id long, quality int"))
    fold = {k: zlib.crc32(str(k).encode()) % 5 for k in label}
    x = quality.statistics([t.encode() for _, t in rows])
    use = np.array([fold[k] != 0 for k, _ in rows])
    y, own = np.array([label[k] for k, _ in rows], float), np.array([fold[k] for k, _ in rows])
    assert np.allclose(model.centre, x[use].mean(axis=0))
    z, n = model.features(x), use.sum()
    w = np.where(y > 0, *reversed(np.clip(0.5 * n / np.array([n - y[use].sum(), y[use].sum()]), 0.5, 4)))
    fit = use & (own != 4)
    best = np.linalg.solve(z[fit].T @ (z[fit] * w[fit, None]) + 1e-3 * n * np.eye(z.shape[1]), z[fit].T @ (w[fit] * y[fit]))
    assert np.allclose(z @ best, model.raw(x), atol=1e-6) and (np.diff(model.values) > 0).all()


def test_ordinal_fit_is_a_maximum(spark):
    from quarrylane.llm.toxicity import fit_ordinal

    rng = np.random.default_rng(2)
    x = (rng.random((400, 5)) < 0.4).astype(float)
    grade = np.digitize(x @ np.array([2.0, 1, 0, -1, 0.5]) + rng.logistic(size=400), [1.0, 2.5, 4.0])
    r, c = np.nonzero(x)
    w, t = fit_ordinal(r.tolist(), c.tolist(), x[r, c].tolist(), grade, 5, rounds=1500)

    def loss(w, t):
        edge = np.concatenate([[-np.inf], t, [np.inf]])
        line = x @ w
        p = 1 / (1 + np.exp(-(edge[grade + 1] - line))) - 1 / (1 + np.exp(-(edge[grade] - line)))
        return -np.log(p).mean() + 0.02 / 2 * (w @ w) / 5

    assert (np.diff(t) > 0).all()
    for k in range(8):
        for step in (-0.05, 0.05):
            v = np.concatenate([w, t])
            v[k] += step
            assert loss(v[:5], v[5:]) > loss(w, t) - 1e-5


def test_shards_are_cuts_of_one_order(spark):
    from quarrylane.llm.sharding import shard_documents

    r = random.Random(9)
    rows = [(k, r.choice(["hot " * 30, f"t{k} " * r.randint(0, 60)])) for k in range(4000)]
    got = shard_documents(spark.createDataFrame(rows, "doc_id long, text string"), 8).collect()
    texts_ = dict(rows)
    key = {x.t: x.k for x in spark.createDataFrame([(t,) for t in set(texts_.values())], "t string").selectExpr("t", "xxhash64(t) k").collect()}
    order = sorted(got, key=lambda g: (key[texts_[g.doc_id]], g.doc_id))
    assert [g.shard for g in order] == sorted(g.shard for g in order)
    mean = sum(g["size"] for g in got) / 8
    for s in range(8):
        own = [g for g in got if g.shard == s]
        assert abs(sum(g["size"] for g in own) - mean) < 0.02 * mean + max(g["size"] for g in own) and sorted(g.slot for g in own) == list(range(len(own)))


def test_language_model_is_a_distribution(spark):
    from quarrylane.llm import lm_maxent

    vocabulary = [f"v{k}" for k in range(12)]
    r = random.Random(3)
    rows = [(k, " ".join(r.choices(vocabulary, k=8))) for k in range(300)]
    held = [k for k in range(1000, 1200) if zlib.crc32(str(k).encode()) % 7 == 2][:15]
    # every one-word text, one with an unknown word, and the empty text: their first tokens are all outcomes of one context
    firsts = [*vocabulary, "unknown", ""]
    rows += list(zip(held, firsts))
    got = {d.doc_id: d for d in lm_maxent.score_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    ends = {k: got[k].score for k in held[: len(firsts)]}
    # P(word) >= P(word, end), and the sum over all two-token texts and the empty one is at most 1
    total = sum(10 ** s for s in ends.values())
    assert 0 < total <= 1 + 1e-9 and all(s < 0 for s in ends.values())
    known = [got[k] for k in held[: len(vocabulary)]]
    assert all(g.n_known == 2 and g.n_tokens == 2 for g in known) and got[held[12]].n_known == 1


def test_pipeline_against_brute_force(spark, docs):
    from tokenizers import Tokenizer

    import corpus_pipeline
    from quarrylane.llm.bpe import default_vocabulary

    rows = [tuple(r) for r in docs.collect()]
    rows += [rows[30], rows[30]]  # repeated rows
    table = spark.createDataFrame(rows, DOCS)
    sets = {}
    for k, t, *_ in rows:
        w = (t or "").encode().lower().split()
        sets[k] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} if w else set()
    root = {k: k for k in sets}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    text = {k: t for k, t, *_ in rows if find(k) == k}
    kept = corpus_pipeline.one_of_each_group(spark, table, "")
    assert sorted(r.doc_id for r in kept.collect()) == sorted(text)
    seen, gone = set(), {k: set() for k in text}
    for k in sorted(text):
        words = (text[k] or "").encode().split()
        for i in range(len(words) - 19):
            w = tuple(words[i : i + 20])
            if w in seen:
                gone[k] |= set(range(i, i + 20))
            seen.add(w)
    want = {k: t if not gone[k] else b" ".join(w for i, w in enumerate(t.encode().split()) if i not in gone[k]).decode() for k, t in text.items()}
    cleaned = corpus_pipeline.drop_repeated_passages(spark, kept, "")
    assert {r.doc_id: r.text or "" for r in cleaned.collect()} == {k: t or "" for k, t in want.items()}
    library = Tokenizer.from_file(default_vocabulary())
    sizes = {k: len(library.encode(t or "", add_special_tokens=False).ids) + 1 for k, t in want.items()}
    pieces = corpus_pipeline.pack(spark, cleaned, "").groupBy("doc_id").agg({"length": "sum"}).collect()
    assert {r[0]: r[1] for r in pieces} == sizes
    nothing = table.limit(0)
    for _, stage in corpus_pipeline.STAGES[2:]:
        assert stage(spark, nothing, "").count() == 0


def test_stages_begin_with_collected_heaps(spark):
    import corpus_pipeline

    def collections():
        beans = spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
        return sum(b.getCollectionCount() for b in beans if "Old" in b.getName() or "MarkSweep" in b.getName())

    docs = spark.createDataFrame([(1, "some words", "en", "web", 10)], "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES[2:]:
        before = collections()
        stage(spark, docs, "")
        assert collections() > before, name
        if name == "packing":
            before = collections()
            corpus_pipeline.packing.pack(docs)
            assert collections() == before  # so the stage's own collection was seen


def test_packed_numbers_are_small():
    from quarrylane.llm import lm_maxent

    rng = np.random.default_rng(0)
    for x in (np.zeros(0, np.uint64), np.array([0], np.uint64), np.array([2**64 - 1, 0, 5], np.uint64), rng.integers(0, 2**40, 1000, dtype=np.uint64)):
        for noise in (False, True):
            assert np.array_equal(lm_maxent._unpacked(lm_maxent._packed(x, noise)), x)
    gaps = rng.exponential(2**26, 20_000).astype(np.uint64)
    assert len(lm_maxent._packed(gaps, True)) < 3.55 * len(gaps)
    counts = np.minimum(rng.zipf(1.3, 20_000), 10**6).astype(np.uint64)
    assert len(lm_maxent._packed(counts)) < 1.25 * len(counts)
