"""Token counts, the conversation trie and clustering against the library and brute force."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from pixelquarry.llm import clustering, prefix_trie, token_counts
from pixelquarry.llm.queries import tokenizer_path

PARTS = ["a", "b", "the", " ", "  ", "   ", "▁", "▁▁", "\n", "\t", "é", "中文", "😀", "<s>", "</s>", "<unk>", "<0x0A>", "x", "ing", "Z", "1", ".", " ", "　", "\x00", "supercalifragilistic"]


def texts(seed: int, count: int) -> list[str]:
    draw = random.Random(seed)
    return ["".join(draw.choice(PARTS) for _ in range(draw.randint(0, 14))) for _ in range(count)]


@pytest.mark.parametrize("frequent,cached,slice_bytes", [(8192, 400_000, 4_000_000), (3, 5, 60), (1, 1, 1)])
def test_token_counts(spark, monkeypatch, frequent, cached, slice_bytes):
    monkeypatch.setattr(token_counts, "FREQUENT", frequent)
    path = tokenizer_path("piece_bpe_32k.model")
    rows = [(i, t, "x", 5) for i, t in enumerate(texts(4, 3000))]
    rows += [(None, "no identifier", "", 0), (7, "twice", "", 0), (7, "twice", "", 0), (9001, None, "", 0), (9002, "", "", 0), (9003, " ", "", 0)]
    rows += [(9004, "word " * 30_000, "", 0), (9005, "y" * 50_000, "", 0), (9006, " " * 3_000, "", 0)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string, n_bytes int").repartition(3)
    table = spark.sparkContext.broadcast(token_counts.length_table(path, token_counts.frequent_words(frame)))
    assert len(token_counts.frequent_words(frame)) <= frequent
    assert len(table.value) < 10_000_000
    monkeypatch.setattr(token_counts, "CACHED", cached)
    monkeypatch.setattr(token_counts, "SLICE_BYTES", slice_bytes)
    model = token_counts.load_model(path)
    expected = Counter((i, len((t or "").encode()), n := len(model.encode(t or "")), n > 4096) for i, t, *_ in rows)
    got = token_counts.token_counts(frame, path)
    assert Counter(map(tuple, got.collect())) == expected
    assert got.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    assert token_counts.token_counts(frame.limit(0), path).collect() == []
    with pytest.raises(ValueError, match="not a sentencepiece"):
        token_counts.check_model(tokenizer_path("byte_bpe_50k.json"))


def test_token_counts_in_small_slices():
    """The array steps alone, with a tiny first tier and cache, on texts of all kinds of blanks."""
    import pyarrow as pa

    path = tokenizer_path("piece_bpe_32k.model")
    model, some = token_counts.load_model(path), texts(8, 4000)
    for words in ([], ["a", "the"], sorted({w for t in some for w in t.split(" ") if w})):
        lengths = np.array([len(x) for x in model.encode(words)], dtype=np.int32)
        for at in range(0, len(some), 400):
            part = some[at : at + 400]
            got = token_counts.count_tokens(path, pa.array(part, pa.string()), pa.array(words, pa.string()), lengths)
            assert got.tolist() == [len(x) for x in model.encode(part)]


# --- trie ------------------------------------------------------------------------------------


def brute_trie(rows, group=100, heads=6):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(ts)] for c, ts in own.items()}
    built = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % heads
        base = int(np.fmod(c, group))
        built[c] = own.get(c - base, [])[:h] + ts[h:]
    members, ends, children = defaultdict(list), defaultdict(list), defaultdict(set)
    for c, ts in built.items():
        for d in range(len(ts) + 1):
            members[tuple(ts[:d])].append(c)
            if d:
                children[tuple(ts[: d - 1])].add(tuple(ts[:d]))
        ends[tuple(ts)].append(c)
    leaves, saved = Counter(), Counter()
    for node, own_members in members.items():
        for d in range(len(node) + 1):
            leaves[node[:d]] += not children[node]
            saved[node[:d]] += (len(own_members) - 1) * len(node[-1][1]) if node else 0
    for node, m in members.items():
        digest = hashlib.sha256(",".join(map(str, sorted(ends[node]))).encode()).hexdigest()
        yield min(m), len(node), min(members[node[:-1]]) if node else None, len(m), len(children[node]), leaves[node], saved[node], digest


def conversations(seed, count, most, kinds):
    draw = random.Random(seed)
    rows = []
    for c in range(count):
        for turn in range(draw.randint(1, most)):
            rows.append((c * draw.choice([1, 7]), turn, draw.choice(["user", "assistant", None]), draw.choice(kinds)))
    return rows


@pytest.mark.parametrize("forest", [2, 3, 32])
def test_conversation_trie(spark, monkeypatch, forest):
    monkeypatch.setattr(prefix_trie, "FOREST", forest)
    monkeypatch.setattr(prefix_trie, "SEQUENCES", 7)  # many partitions
    ddl = "conv_id long, turn long, role string, text string, key string, path int"
    rows = conversations(3, 400, 5, ["a", "bb", "", None, "é😀x"]) + conversations(4, 60, 9, ["a"])
    rows += [(c, t, "user", "hot") for c in range(1000, 1300) for t in range(6)]  # copies over several partitions
    rows += [(5000 + c, t, "u", "deep") for c in range(3) for t in range(300 + c)]
    rows += [(-5, 0, "user", "a"), (-205, 0, "user", "bb"), (None, 0, "user", "a"), (7, None, None, None), (7, None, None, None), (9, 0, "user", "a"), (9, 0, "user", "a")]
    frame = spark.createDataFrame([(*r, "k", 1) for r in rows], ddl).repartition(5)
    got = Counter(map(tuple, prefix_trie.conversation_trie(frame).collect()))
    assert got == Counter(brute_trie(rows))
    assert prefix_trie.conversation_trie(frame.limit(0)).collect() == []


@pytest.mark.parametrize("rows", [[(1, 0, "user", "x")], [(1, 0, "user", "x"), (2, 0, "user", "x")], [(c, 0, "u", "same") for c in range(200)], [(c, t, "u", str(c % 3)) for c in range(90) for t in range(3)]])
def test_conversation_trie_of_few_and_of_copies(spark, monkeypatch, rows):
    monkeypatch.setattr(prefix_trie, "SEQUENCES", 10)
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert Counter(map(tuple, prefix_trie.conversation_trie(frame).collect())) == Counter(brute_trie(rows))


# --- clustering ------------------------------------------------------------------------------


def brute_clusters(rows, k=16, rounds=3, scale=64, dim=64, seed=1):
    kept = [(i, [int(np.floor(scale * x)) for x in v]) for i, v in rows if v is not None and len(v) == dim and None not in v and np.isfinite(v).all()]
    order = sorted((hashlib.sha256(f"{seed}:{i}".encode()).hexdigest(), q) for i, q in kept if i is not None)
    centroids = [q for _, q in order[:k]]

    def near(q):
        return min((sum((a - b) ** 2 for a, b in zip(q, c)), j) for j, c in enumerate(centroids))

    for _ in range(rounds):
        groups = defaultdict(list)
        for _, q in kept:
            groups[near(q)[1]].append(q)
        centroids = [[sum(x) // len(groups[j]) for x in zip(*groups[j])] if groups[j] else c for j, c in enumerate(centroids)]
    found = [(i, near(q)) for i, q in kept]
    own = Counter()
    for _, (d, j) in found:
        own[j] += d
    for i, (d, j) in found:
        yield i, j, d, own[j], sum(own.values()), hashlib.sha256(",".join(map(str, centroids[j])).encode()).hexdigest()


@pytest.mark.parametrize("dim,k,spread", [(64, 16, 0.3), (2, 5, 0.05), (3, 40, 0.02), (4, 1, 1.0)])
def test_cluster(spark, monkeypatch, dim, k, spread):
    monkeypatch.setattr(clustering, "BATCH", 50)
    rng = np.random.default_rng(dim)
    rows = [(i, [float(x) for x in rng.normal(0, spread, dim)]) for i in range(400)]
    rows += [(400 + i, rows[3][1]) for i in range(100)] + [(7, rows[7][1])]  # a hot vector, a repeated row
    rows += [(600, None), (601, [None] * dim), (602, [float("nan")] * dim), (603, [float("inf")] * dim), (604, [0.1] * (dim + 1)), (None, [0.1] * dim)]
    frame = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<double>, q int, cluster string").repartition(4)
    got = clustering.cluster(frame, k=k, dim=dim)
    assert Counter(map(tuple, got.collect())) == Counter(brute_clusters(rows, k=k, dim=dim))
    assert clustering.cluster(frame.limit(0)).collect() == []


def test_cluster_keeps_large_components_exact_and_refuses_larger(spark):
    ddl = "vec_id long, embedding array<double>"
    rows = [(i, [3e7 + i / 64, -3e7]) for i in range(30)]
    got = clustering.cluster(spark.createDataFrame(rows, ddl), k=3, dim=2)
    assert Counter(map(tuple, got.collect())) == Counter(brute_clusters(rows, k=3, dim=2))
    for far in (1e20, 6e16):
        with pytest.raises(Exception, match="64 bits"):
            clustering.cluster(spark.createDataFrame([(0, [far, 0.0]), (1, [-far, 0.0])], ddl), k=1, dim=2).collect()


def test_nearest_finds_ties_and_skips_nodes():
    rng = np.random.default_rng(1)
    for dim, size in ((1, 3), (2, 4), (3, 8), (8, 30)):
        centroids = rng.integers(-size, size, (23, dim))  # many equal distances, some equal centroids
        vectors = rng.integers(-size - 2, size + 2, (500, dim))
        number, distance = clustering.nearest(clustering.build_tree(centroids), vectors)
        every = np.square(vectors[:, None, :] - centroids[None]).sum(axis=2)
        assert (number == every.argmin(axis=1)).all() and (distance == every.min(axis=1)).all()
