"""The pipeline on planted cases, and what registration promises."""

import gc
import random
import weakref
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from cellshift.llm import common, encoding, near_copies, toxicity_crf
from tests.llm.test_operators import marked_texts

BENCHMARK = "what is the sum of all the odd numbers below one hundred and eleven in this list of primes"


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(11)
    toxic = marked_texts(120)
    rows = [(i, t, "en", "s0", len(t)) for i, t, _ in toxic]
    body = [" ".join(rng.choice("abcdefgh") + rng.choice("mnop") + str(rng.randrange(40)) for _ in range(200)) for _ in range(6)]
    for k in range(3):  # ids 200..: exact and near copies
        rows += [(200 + 10 * k + j, body[k] + " end" * (j == 2), "en", "s1", None) for j in range(3)]
    rows += [(300, body[3] + " " + BENCHMARK.upper() + " " + body[4], "en", "s1", 1), (301, BENCHMARK[:30] + " " + body[5], "en", "s1", 1)]
    rows += [(400, "reach me at some.one@mail.example.com now", "en", "s2", 41), (401, None, None, None, None), (402, "clean text stays", "en", "s2", 16)]
    folder = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 1, y) for i, _, y in toxic], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, BENCHMARK)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, {r[0]: r for r in rows}


def test_stages(spark, corpus, tmp_path):
    folder, rows = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, seen = docs.columns, []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, folder).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        if k < 4:
            assert docs.columns == columns, name
        seen.append({r["doc_id"]: r for r in docs.collect()})
    assert set(seen[0]) == {i for i in rows if i >= 120 or i % 2 == 0}
    assert {i for i in seen[1] if 200 <= i < 300} == {200, 210, 220} and set(seen[1]) >= {0, 2, 118, 300, 301, 400, 401, 402}
    assert set(seen[1]) - set(seen[2]) == {300}
    assert set(seen[3]) == set(seen[2]) and "some.one" not in seen[3][400]["text"] and seen[3][400]["n_chars"] == len(seen[3][400]["text"])
    assert all(seen[3][i] == seen[2][i] for i in seen[2] if i != 400)
    used = defaultdict(int)
    for r in docs.collect():
        used[r["sequence_id"]] += r["length"]
    assert {r["doc_id"] for r in docs.collect()} == set(seen[3]) and max(used.values()) <= 4096


def test_run_equals_its_stages(spark, corpus):
    folder, rows = corpus
    got = corpus_pipeline.run(spark, folder).collect()
    assert len({r["doc_id"] for r in got}) == sum(1 for i in rows if (i >= 120 or i % 2 == 0)) - 6 - 1


def test_repeated_and_unnamed_rows(spark, corpus):
    folder, _ = corpus
    docs = spark.createDataFrame([(1, "same text here", "en"), (1, "same text here", "en"), (None, "other words follow now", "en"), (2, "same text here", "en")], "doc_id long, text string, lang string")
    kept = corpus_pipeline.near_duplicates(spark, docs, folder).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in kept) == [(False, 1), (True, 0)]


def test_empty_tables(spark, corpus):
    folder, _ = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet").where("false")
    for name, stage in corpus_pipeline.STAGES:
        docs_out = stage(spark, docs, folder)
        assert docs_out.count() == 0, name


def test_registered():
    import __spark_entry__ as entry

    names = entry.queries()
    assert {f"op{n}_" for n in range(1, 11)} <= {x[: x.index("_") + 1] for x in names if x.startswith("op")} and "pipeline" in names


def jaccard(a, b):
    def shingles(t):
        ws = t.lower().split()
        return {tuple(ws[i : i + 5]) for i in range(max(1, len(ws) - 4))}

    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b)


def test_near_copies_match_brute_force(spark, corpus):
    """Copies of similarity 0.6 to 1, many of them 0.8 to 0.95, some sharing a long passage, one large group."""
    folder, _ = corpus
    rng = random.Random(5)
    words = lambda n: [f"w{rng.randrange(500)}" for _ in range(n)]
    passage, texts = words(40), []
    for _ in range(40):
        body = words(rng.randint(4, 150))
        body = body + passage if rng.random() < 0.5 else body
        texts.append(" ".join(body))
        for _ in range(rng.randint(0, 3)):
            copy = list(body)
            for _ in range(rng.randint(1, max(1, len(body) // 25))):
                copy[rng.randrange(len(copy))] = f"x{rng.randrange(500)}"
            texts.append(" ".join(copy))
    body = words(100)
    texts += [" ".join([*body, f"y{i}"]) for i in range(40)] + [texts[0], "", "short one", "Short  ONE"]
    rng.shuffle(texts)
    root, close = list(range(len(texts))), 0
    for i in range(len(texts)):
        for j in range(i):
            likeness = jaccard(texts[i], texts[j])
            close += 0.8 <= likeness < 0.95
            if likeness >= 0.8:
                a, b = sorted((root[i], root[j]))
                root = [a if r == b else r for r in root]
    assert close > 20
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    got = [r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, folder).collect()]
    assert sorted(got) == sorted(set(root))


def test_two_texts_under_one_id(spark, corpus):
    """Rows are judged by id and text: neither drags the other out, and null ids are no way through."""
    folder, _ = corpus
    copy, own = "this text is here twice under ids of its own and of another", "quite different words that nobody else has written down so far"
    leak, clean = "first " + BENCHMARK, "clean words beside it that hold no question at all"
    rows = [(1, copy), (2, copy), (2, own), (3, leak), (3, clean), (None, leak + " again"), (None, "plain words without a name"), (None, "plain words without a name")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = corpus_pipeline.near_duplicates(spark, docs, folder)
    assert {(r["doc_id"], r["text"]) for r in kept.collect()} == {(1, copy), (2, own), (3, leak), (3, clean), (None, "plain words without a name")}
    assert sorted(r["text"] for r in corpus_pipeline.decontaminate(spark, docs, folder).collect()) == sorted([copy, copy, own, clean, rows[6][1], rows[7][1]])


def components_of(texts):
    """Smallest index of each component of pairs of similarity 0.8 or more."""
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if jaccard(texts[i], texts[j]) >= 0.8:
                a, b = sorted((root[i], root[j]))
                root = [a if r == b else r for r in root]
    return root


def test_near_copies_of_hot_keys(spark, corpus, monkeypatch):
    """A passage that a third of all texts begin with and end with, apart from it unlike; a large group of near copies; a long
    text twice; cells cut into a grid of blocks, common keys or none of them, and columns of names used inside."""
    folder, _ = corpus
    rng = random.Random(8)
    words = lambda n: [f"w{rng.randrange(900)}" for _ in range(n)]
    passage, body = words(60), words(80)
    texts = [" ".join([*passage, *words(rng.randint(5, 25))]) for _ in range(60)]
    texts += [" ".join([*body, f"z{i}", f"y{i}"]) for i in range(50)] + [" ".join([*body[:70], *words(rng.randint(5, 9))]) for _ in range(20)]
    texts += [" ".join(words(rng.randint(1, 40))) for _ in range(30)] + [texts[3]] * 15
    long = words(60_000)
    texts += [" ".join(long), " ".join([*long[:50_000], "else", *long[50_000:]]), " ".join(long[:40_000])]
    want = components_of(texts)
    rows = [(i, t, *["x"] * 6) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, node string, key string, root string, n string, same string, row string").repartition(6)
    for cell_rows, common in ((2048, 16), (8, 3), (8, 10_000)):
        monkeypatch.setattr(near_copies, "COMMON", common)
        monkeypatch.setattr(near_copies.across, "__defaults__", (cell_rows,))
        got = near_copies.grouped(docs.select("doc_id", "text", "node", "key", "root", "n", "row", F.lit("y").alias("same"))).collect()
        first = {}
        for r in sorted(got, key=lambda r: r["doc_id"]):
            first.setdefault(r["component"], r["doc_id"])
        assert [first[r["component"]] for r in sorted(got, key=lambda r: r["doc_id"])] == want
    kept = corpus_pipeline.near_duplicates(spark, docs.drop("same"), folder)
    assert kept.columns == docs.drop("same").columns and sorted(r["doc_id"] for r in kept.collect()) == sorted(set(want))


def test_sketches_never_rule_out_a_near_pair():
    """Counts of hash buckets, cut at 255, bound the overlap from above."""
    rng = np.random.default_rng(3)
    for n in (1, 2, 9, 40, 400, 90_000):
        for share in (0.5, 0.79, 0.8, 0.81, 0.9, 1.0):
            pool = rng.integers(0, 1 << 63, 3 * n, dtype=np.uint64) * np.uint64(2)
            both = int(round(share * n))
            a, b = pool[:n], np.concatenate([pool[:both], pool[n : n + max(0, n - both) // 2]])
            a, b = np.unique(a), np.unique(b)
            met = len(np.intersect1d(a, b))
            s, t = (near_copies.folded(np.frombuffer(near_copies.sketch(x), dtype=np.uint8), 128 if n < 9 else 256 if n < 500 else 4096)[None, :] if len(x) > 600 else
                    near_copies.folded(np.frombuffer(near_copies.sketch(x), dtype=np.uint8), 128)[None, :] for x in (a, b))
            if met >= 0.8 * (len(a) + len(b) - met):
                assert near_copies.may_be_alike(np.array([len(a)]), s, np.array([len(b)]), t, 0.8).all()


def test_shared_keys_over_batches(spark):
    """Runs of keys that go on over Arrow batches."""
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    try:
        cells = [(k, n) for k, size in ((1, 1), (2, 2), (3, 7), (4, 1), (5, 1), (6, 3), (7, 1)) for n in range(10, 10 + size)]
        got = near_copies.shared(spark.createDataFrame(cells, "key long, node long").repartition(3)).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    assert sorted(tuple(r) for r in got) == [(k, n, 10) for k, size in ((2, 2), (3, 7), (6, 3)) for n in range(10, 10 + size)]


def test_fingerprints_come_first(spark, monkeypatch):
    """The stage links texts by SimHash as operator 5 does and verifies them; only what is still apart is compared inside cells."""
    rng = random.Random(4)
    words = lambda n: [f"v{rng.randrange(5000)}" for _ in range(n)]
    body = words(900)
    texts = [" ".join([*body, f"end{i}"]) for i in range(6)] + [" ".join(words(30)) for _ in range(10)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    seen, verify = [], near_copies.settled

    def spy(pairs, edges, *rest):
        seen.append(({tuple(r) for r in pairs.collect()}, edges is None))
        return verify(pairs, edges, *rest)

    monkeypatch.setattr(near_copies, "settled", spy)
    got = {r["doc_id"]: r["component"] for r in near_copies.grouped(docs).collect()}
    assert len({got[i] for i in range(6)}) == 1 and len(set(got.values())) == 11
    nodes = spark.createDataFrame([(1, 0), (2, 7), (3, 7), (4, 255 << 20)], "node long, fp long")
    assert {tuple(r) for r in near_copies.by_fingerprint(nodes, 3).collect()} == {(1, 2), (2, 3)}
    assert [first for _, first in seen] == [True, False] and len(seen[0][0]) >= 5 and not seen[1][0]


def variants(rng, n=90, words=120, places=16, most=8):
    """Copies of a text, each with some of the same words replaced: those that differ in 2 places are alike, those in 3 nearly so."""
    body, texts = [f"b{i}" for i in range(words)], []
    for _ in range(n):
        changed = {at * words // places for at in rng.sample(range(places), rng.randint(1, most))}
        texts.append(" ".join(f"x{i}" if i in changed else w for i, w in enumerate(body)))
    return texts


def test_cells_tell_no_more_rows_than_they_hold(spark):
    """A group whose pairs nearly all may be alike: its rows are told, not its pairs; near rows are in one cluster; trees have one pair less than rows."""
    texts = variants(random.Random(2))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("same", F.col("doc_id"))
    nodes = near_copies.marks(docs, np.array([], dtype=np.uint64), 5, 0.8).localCheckpoint()
    name = {r["doc_id"]: r["node"] for r in nodes.select("doc_id", "node").collect()}
    cells = nodes.select(F.explode(F.array(F.lit(1).cast("long"), F.lit(2).cast("long"))).alias("key"), "node", F.col("node").alias("root")).where("key = 1 or node % 2 = 0")
    for cell_rows in (2048, 20):
        grid = near_copies.gridded(cells, "1", cell_rows).count()
        told = near_copies.across(cells, nodes, 0.8, cell_rows).collect()
        assert len(told) <= grid
        held, tree = {}, {}
        for r in told:
            held.setdefault(r["key"], set()).add(r["node"])
            tree.setdefault(r["key"], set()).update({(r["u"], r["v"])} if r["u"] is not None else ())
        assert all(len(tree[k]) == len(held[k]) - 1 and {x for pair in tree[k] for x in pair} == held[k] for k in held)
        for i in range(len(texts)):
            for j in range(i):
                assert jaccard(texts[i], texts[j]) < 0.8 or any({name[i], name[j]} <= x for x in held.values())


def test_groups_near_the_threshold_match_brute_force(spark, monkeypatch):
    """A group whose pairs are nearly all close to the similarity, in cells and clusters cut into blocks."""
    rng = random.Random(9)
    texts = variants(rng) + [" ".join(f"u{rng.randrange(900)}" for _ in range(30)) for _ in range(10)]
    want, first = components_of(texts), {}
    assert 15 < len(set(want)) < len(texts) - 40
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    monkeypatch.setattr(near_copies.across, "__defaults__", (64,))
    monkeypatch.setattr(near_copies.inside, "__defaults__", (8 * 116 * 40,))
    got = sorted(near_copies.grouped(docs).collect(), key=lambda r: r["doc_id"])
    for r in got:
        first.setdefault(r["component"], r["doc_id"])
    assert [first[r["component"]] for r in got] == want


@pytest.mark.parametrize("cell_bytes", [4 << 20, 8 * 116 * 12])
def test_clusters_are_compared_whole(spark, cell_bytes):
    """No pair of the tree of a cluster is near here: all near pairs are found inside, and none is told that the others unite."""
    texts = variants(random.Random(7), n=40, places=12)
    want = components_of(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("same", F.xxhash64("text")).localCheckpoint()
    marked = near_copies.marks(docs, np.array([], dtype=np.uint64), 5, 0.8).localCheckpoint()
    name = {r["doc_id"]: r["node"] for r in marked.collect()}
    nodes = marked.dropDuplicates(["node"])
    clusters = nodes.select(F.explode(F.array(F.lit(1).cast("long"), F.lit(2).cast("long"))).alias("key"), "node", "n").where("key = 1 or node % 2 = 0")
    edges = spark.createDataFrame([(1, 2)], "u long, v long")
    found = {tuple(r) for r in near_copies.inside(clusters, edges, docs, nodes, 5, 0.8, cell_bytes).collect()} - {(1, 2)}
    label = {x: x for x in name.values()}
    for u, v in found:
        label = {x: label[u] if y == label[v] else y for x, y in label.items()}
    assert len({label[name[i]] for i in range(len(texts))}) == len(set(want))
    assert all(label[name[i]] == label[name[want[i]]] for i in range(len(texts)))


def test_joining_unites_what_all_near_pairs_unite():
    rng = np.random.default_rng(6)
    for _ in range(60):
        pool, n = rng.integers(0, 1 << 63, 40, dtype=np.uint64), int(rng.integers(2, 14))
        sets = [np.unique(np.delete(pool, rng.integers(0, 40, int(rng.integers(0, 9))))) for _ in range(n)]
        root = rng.integers(0, 8, n)
        want, got = root.tolist(), root.tolist()
        pairs = near_copies.joining(root, sets, 0.8)
        for label, some in ((got, pairs), (want, [(i, j) for i in range(n) for j in range(i)])):
            for i, j in some:
                both = len(np.intersect1d(sets[i], sets[j]))
                if both >= 0.8 * (len(sets[i]) + len(sets[j]) - both) - 1e-9:
                    label[:] = [label[i] if x == label[j] else x for x in label]
                else:
                    assert label is want
        assert len(pairs) < n and all((got[i] == got[j]) == (want[i] == want[j]) for i in range(n) for j in range(n))


def test_whole_cells_over_batches():
    cell = np.array([1, 1, 1, 2, 3, 3, 4, 5, 5, 5, 5, 6])
    for cuts in ([3], [1, 2], [4, 4, 6], [1, 3, 7, 8, 9, 11], []):
        batches = [pa.RecordBatch.from_arrays([pa.array(x)], names=["cell"]) for x in np.split(cell, cuts)]
        got = [t.column("cell").to_pylist() for t in near_copies.whole_cells(iter(batches))]
        assert sum(got, []) == cell.tolist() and sum(len(set(x)) for x in got) == 6


def test_cells_of_the_same_nodes_are_compared_once(spark):
    cells = [(k, node, node) for k in range(30) for node in (1, 2, 3)] + [(40, 1, 1), (40, 2, 2), (50, 4, 4), (50, 5, 4)]
    kept = near_copies.unlike_cells(spark.createDataFrame(cells, "key long, node long, root long")).collect()
    assert sorted(map(tuple, kept)) == [(0, 3), (40, 2)]


def test_workers_keep_one_model_at_a_time():
    model = toxicity_crf.Model(np.zeros(toxicity_crf.DIM, np.float32), np.zeros((2, 2)), np.zeros(4), np.zeros(3), np.ones(3))

    def scorers():
        return sum(1 for x in gc.get_objects() if type(x) is toxicity_crf.WordScores)

    held = weakref.ref(encoding.encoder(encoding.default_path()))
    assert held() is encoding.encoder(encoding.default_path())
    score = toxicity_crf._scored(model, "one", ["some words"])[0]
    assert held() is None and scorers() == 1
    assert toxicity_crf._scored(model, "one", ["some words"])[0] == score and scorers() == 1
    encoding.encoder(encoding.default_path())
    assert scorers() == 0
    common.release()
    assert not any(type(x) is encoding.PieceEncoder for x in gc.get_objects())


def test_slices_let_go_of_a_batch_before_the_next():
    seen, gone = [], []

    def source():
        for k in range(3):
            batch = pa.RecordBatch.from_arrays([pa.array([f"text {k}", None, "x" * 9])], names=["text"])
            seen.append(weakref.ref(batch))
            yield batch
            del batch
            gone.append(seen[-1]() is None)

    assert [b.num_rows for b in common.batch_slices(source(), limit=10)] == [2, 1] * 3
    assert gone == [True] * 3
