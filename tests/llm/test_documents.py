"""Operators on documents against brute force, on a table of edge cases.

The table has null and repeated identifiers, null, empty, blank and very long texts, exact and near
copies, repeated rows, and extra columns whose names clash with those that operators use inside.
"""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash
from tokenizers import Tokenizer

from pixelquarry.llm import bpe, exact_dedup, language_id, mixing, simhash, substring_dedup, token_files

DDL = "doc_id long, text string, lang string, source string, n_chars long, id long, hash string, block string, node string, key string, at string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def make_rows():
    rng = random.Random(7)
    vocabulary = ["".join(rng.choices("abcdeéü", k=rng.randint(1, 7))) for _ in range(300)]
    say = lambda n: " ".join(rng.choices(vocabulary, k=n))
    shared, base = say(60), say(200)
    texts = [None, "", "", "  \t\n ", "word", "Two\x0bwords", "a\u00a0b \u2003c", "x<|endoftext|>y <|startoftext|>", "don't I'M 42 ½ 日本語", "a  b\n\nc "]
    texts += [say(rng.randint(1, 120)) for _ in range(40)]
    texts += [base, base.upper(), base + " tail", base, base]
    texts += [say(20) + " " + shared + " " + say(20) for _ in range(5)] + [shared + " " + shared]
    texts += [say(20_000), "z" * 50_000]
    rows = [(i, t, rng.choice(["en", "de", None]), rng.choice(["s1", "s2", "s10", None]), 1, 9, "h", "b", "n", "k", "t") for i, t in enumerate(texts)]
    rows += [rows[12], rows[12], (None, "null id", "en", "s1", 1, 9, "h", "b", "n", "k", "t"), (None, base, "en", "s1", 1, 9, "h", "b", "n", "k", "t"), (3, "same id", "de", None, 1, 9, "h", "b", "n", "k", "t")]
    rng.shuffle(rows)
    return rows


ROWS = make_rows()


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("docs") / "documents.parquet")
    spark.createDataFrame(ROWS, DDL).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DDL)


def counted(rows):
    return Counter(map(tuple, rows))


@pytest.mark.parametrize("keep", ["min", "max"])
def test_exact_dedup(docs, empty, keep):
    groups = defaultdict(list)
    for row in ROWS:
        groups[row[1] or ""].append(row[0])
    got = exact_dedup.exact_dedup(docs, keep=keep).collect()
    assert len(got) == len(ROWS)
    best = {t: (min if keep == "min" else max)((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
    want = Counter((i, best[t], len(ids), hashlib.sha256(t.encode()).hexdigest()) for t, ids in groups.items() for i in ids)
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == want
    kept = Counter(r.text_sha256 for r in got if r.kept)
    assert set(kept.values()) == {1} and len(kept) == len(groups)
    assert all(r.doc_id == r.keep_id for r in got if r.kept)
    assert exact_dedup.exact_dedup(empty).collect() == []


def test_exact_dedup_groups_span_partitions(spark):
    """One hot text is dealt over partitions and merged by full text."""
    hot = spark.range(4000).selectExpr("id AS doc_id", "if(id % 4 = 0, concat('t', id), 'hot') AS text")
    got = exact_dedup.exact_dedup(hot.repartition(8)).groupBy("group_size", "kept").count().collect()
    assert {(r.group_size, r.kept): r["count"] for r in got} == {(1, True): 1000, (3000, True): 1, (3000, False): 2999}


def test_kept_documents_keep_columns(docs):
    kept = exact_dedup.kept_documents(docs, keep="max")
    assert kept.columns == docs.columns
    assert kept.count() == len({r[1] or "" for r in ROWS})


def brute_fingerprint(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def brute_components(prints, radius):
    parent = list(range(len(prints)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(prints)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= radius:
                parent[root(a)] = root(b)
    return [root(x) for x in range(len(prints))]


def test_simhash(docs, empty):
    prints = [brute_fingerprint(r[1]) for r in ROWS]
    roots = brute_components(prints, 4)
    least = {}
    for root, row in zip(roots, ROWS):
        if row[0] is not None:
            least[root] = min(least.get(root, row[0]), row[0])
    want = Counter((r[0], f"{p:016x}", least.get(root)) for r, p, root in zip(ROWS, prints, roots))
    assert counted(simhash.simhash_components(docs).collect()) == want
    assert simhash.simhash_components(empty).collect() == []
    kept = simhash.kept_documents(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect() if r.doc_id is not None} == set(least.values())


def test_simhash_keeps_one_row_of_each_component(spark, docs):
    """Whatever identifiers repeat or are missing."""
    b, c = "one two three four five six", "seven eight nine ten eleven twelve"
    base = next(r[1] for r in ROWS if r[1] and r[1].endswith(" tail"))
    more = [(5, b), (5, c), (4, b.upper()), (None, c + " "), (None, base), (None, base[:-5]), (None, "alone here"), (None, "Alone here"), (None, "apart"), (5, "apart too"), (5, "apart too"), (5, None), (5, "")]
    for frame, rows in ((docs, ROWS), (spark.createDataFrame(more, "doc_id long, text string"), more)):
        roots = brute_components([brute_fingerprint(r[1]) for r in rows], 4)
        root_of = {(r[0], r[1]): root for r, root in zip(rows, roots)}
        least = {}
        for root, r in zip(roots, rows):
            least[root] = min(least.get(root, (True, 0)), (r[0] is None, r[0] or 0))
        kept = simhash.kept_documents(frame).collect()
        assert Counter(root_of[r.doc_id, r.text] for r in kept) == dict.fromkeys(roots, 1)
        assert all(least[root_of[r.doc_id, r.text]] == (r.doc_id is None, r.doc_id or 0) for r in kept)


def test_simhash_long_chain_and_dense_tiles(spark):
    """A chain that only links reach, and a tile whose nodes are all near each other."""
    rng = np.random.default_rng(1)
    chain = np.cumsum(np.ones(40, dtype=np.uint64) * 0) ^ np.array([(1 << (4 * k % 64)) * 15 % (1 << 64) for k in range(40)], dtype=np.uint64)
    chain = np.bitwise_xor.accumulate(chain)
    dense = np.uint64(0xFFFF0000FFFF0000) ^ (np.uint64(1) << rng.integers(0, 64, 60).astype(np.uint64))
    far = rng.integers(0, 1 << 63, 300).astype(np.uint64)
    nodes = np.unique(np.concatenate([chain, dense, far]))
    frame = spark.createDataFrame([(int(x),) for x in nodes.view(np.int64)], "node long")
    found = {r.node: r.root for r in simhash.components(simhash.near_links(frame, 4)).collect()}
    roots = brute_components([int(x) for x in nodes], 4)
    mine = [found.get(int(x), int(x)) for x in nodes.view(np.int64)]
    assert len(set(zip(roots, mine))) == len(set(roots)) == len(set(mine))


def test_tile_forest_skips_nothing():
    rng = np.random.default_rng(2)
    a = rng.integers(0, 1 << 16, 400).astype(np.uint64)
    a = np.unique(a)
    a = a[np.argsort(np.bitwise_count(a), kind="stable")]
    edges = simhash.tile_forest(a, a, True, 2)
    assert all(0 < int(x ^ y).bit_count() <= 2 for x, y in edges.tolist())
    roots = brute_components([int(x) for x in a], 2)
    assert len(edges) == len(a) - len(set(roots))


def brute_repeats(texts, length):
    words = [WORD.findall(t or "") for t in texts]
    seen = Counter(tuple(w[i : i + length]) for w in words for i in range(len(w) - length + 1))
    for w in words:
        gone = [False] * len(w)
        for i in range(len(w) - length + 1):
            if seen[tuple(w[i : i + length])] > 1:
                gone[i : i + length] = [True] * length
        yield len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g)


@pytest.mark.parametrize("length", [35, 8])
def test_substring_dedup(docs, empty, length):
    want = Counter((r[0], *found) for r, found in zip(ROWS, brute_repeats([r[1] for r in ROWS], length)))
    assert counted(substring_dedup.remove_repeats(docs, length).collect()) == want
    assert substring_dedup.remove_repeats(empty).collect() == []
    digest = substring_dedup.repeats_digest(docs, length).collect()
    assert Counter(r.kept_sha256 for r in digest) == Counter(hashlib.sha256(k[3].encode()).hexdigest() for k in want.elements())


def test_substring_overlapping_repeats(spark):
    rows = [(1, "ab " * 100), (2, "x " * 36), (3, "q")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_removed) for r in substring_dedup.remove_repeats(df, 35).collect()}
    assert got == {1: (100, 100), 2: (36, 36), 3: (1, 0)}


def test_substring_equality_is_of_words(spark):
    """Two long words that any polynomial hash modulo 2 ** 64 takes for one are not one."""
    bits = [bin(i).count("1") % 2 for i in range(1024)]
    one, other = "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)
    shared = " ".join(f"w{i}" for i in range(34))
    df = spark.createDataFrame([(i, f"{shared} {w}") for i, w in enumerate((one, other, "zzz"))], "doc_id long, text string")
    assert [r.n_removed for r in substring_dedup.remove_repeats(df, 35).collect()] == [0, 0, 0]
    df = df.union(df.where("doc_id = 0"))
    assert sorted((r.doc_id, r.n_removed) for r in substring_dedup.remove_repeats(df, 35).collect()) == [(0, 35), (0, 35), (1, 0), (2, 0)]


def test_bpe(docs, empty):
    path = public_tokenizers.path("word_bpe_49k.json")
    plain = Tokenizer.from_file(str(path))
    want = Counter()
    for row in ROWS:
        ids = plain.encode(row[1] or "", add_special_tokens=False).ids
        decoded = plain.decode(ids, skip_special_tokens=False)
        want[(row[0], len(ids), *(hashlib.sha256(x.encode()).hexdigest() for x in (" ".join(map(str, ids)), decoded)))] += 1
    assert counted(bpe.encode_digest(docs, str(path)).collect()) == want
    assert bpe.encode_digest(empty, str(path)).collect() == []
    encoded = bpe.encode(docs.where("length(text) < 1000 OR text IS NULL"), str(path))
    back = Counter(r.decoded for r in bpe.decode(encoded, str(path)).collect())
    short = [r[1] for r in ROWS if r[1] is None or len(r[1]) < 1000]
    assert back == Counter(plain.decode(plain.encode(t or "", add_special_tokens=False).ids, skip_special_tokens=False) for t in short)


def test_bpe_refuses_tokenizers_that_keep_blanks():
    with pytest.raises(ValueError):
        bpe.check_tokenizer(str(public_tokenizers.path("byte_bpe_50k.json")))


def test_positions_round_trip():
    rng = np.random.default_rng(0)
    for top in (1, 50_000, 10_000_000):
        numbers = rng.integers(0, top, 5000)
        assert (bpe.unpack_positions(bpe.pack_positions(numbers)) == numbers).all()
    assert len(bpe.unpack_positions(bpe.pack_positions(np.zeros(0, dtype=np.int64)))) == 0


def test_token_files(docs, empty):
    path = str(public_tokenizers.path("byte_bpe_50k.json"))
    plain = Tokenizer.from_file(path)
    order = sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    want, start = Counter(), 0
    for row in order:
        ids = plain.encode(row[1] or "", add_special_tokens=False).ids + [2]
        want[(row[0], start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes()))] += 1
        start += len(ids)
    assert counted(token_files.read_token_files(token_files.write_token_files(docs, path, 2)).collect()) == want
    assert token_files.read_token_files(token_files.write_token_files(empty, path, 2)).collect() == []


@pytest.mark.parametrize("percentile", [50, 90, 98, 100])
def test_frame_of_reference_round_trip(percentile):
    rng = np.random.default_rng(3)
    for n in (0, 1, 255, 256, 257, 20_000):
        for top in (1, 3, 60_000, 1 << 32):
            ids = rng.integers(0, top, n, dtype=np.uint64).astype(np.uint32)
            assert (token_files.unpack(token_files.pack(ids, percentile)) == ids).all()
    skewed = np.where(rng.random(10_000) < 0.03, 49_000, rng.integers(0, 500, 10_000)).astype(np.uint32)
    assert len(token_files.pack(skewed, 90)) < 0.9 * len(token_files.pack(skewed, 100))


def test_mixing(docs, empty):
    got = mixing.mix_sources(docs, block_words=16).collect()
    sizes = Counter((r[0], len(WORD.findall(r[1] or ""))) for r in ROWS)
    assert Counter((r.doc_id, r["size"]) for r in got) == sizes
    by_source = defaultdict(int)
    for r in ROWS:
        by_source[r[3]] += len(WORD.findall(r[1] or ""))
    order = sorted((s for s in by_source if s is not None)) + [None] * (None in by_source)
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    total, target, free = 1.5 * sum(by_source.values()), {}, set(order)
    while True:  # share, stop those above twice their size, share the rest again
        left = total - sum(target.values())
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 2 * by_source[s]}
        if not over:
            target |= share
            break
        target |= {s: 2.0 * by_source[s] for s in over}
        free -= over
    taken = defaultdict(int)
    for r in got:
        assert r.source_size == by_source[r.source] and r.target == pytest.approx(target[r.source])
        assert 0 <= r.taken <= 2 * r["size"]
        taken[r.source] += r.taken
    assert all(abs(taken[s] - target[s]) < 1 for s in order)
    assert all((r.first_slot is None) == (r.taken == 0) for r in got)
    again = mixing.mix_sources(docs.repartition(5), block_words=16).collect()
    assert Counter((r.doc_id, r["size"], r.source) for r in got if r.taken) == Counter((r.doc_id, r["size"], r.source) for r in again if r.taken)
    assert mixing.mix_sources(empty).collect() == []


def test_mixed_documents(docs):
    mixed = mixing.mixed_documents(docs, block_words=16)
    assert mixed.columns == docs.columns
    passes = mixing.mix_sources(docs, block_words=16).agg({"passes": "sum"}).first()[0]
    assert mixed.count() == passes


def test_schedule_is_spread(docs):
    """Any stretch of the schedule holds each source about in proportion."""
    targets = [("sa", 100_000, 60_000.0), ("sb", 50_000, 30_000.0), ("sc", 10_000, 10_000.0)]
    frame = docs.sparkSession.createDataFrame(targets, "key string, source_size long, target double")
    slots = sorted(mixing.schedule(frame, 100).select("slot", "key", "length").collect())
    assert Counter(k for _, k, _ in slots) == {"sa": 600, "sb": 300, "sc": 100}
    for at in range(0, 900, 100):
        part = Counter(k for _, k, _ in slots[at : at + 100])
        assert abs(part["sa"] - 60) <= 6 and abs(part["sb"] - 30) <= 6


def test_language_id(spark, empty):
    rng = random.Random(3)
    words = {"en": "the of and thing with was here that on under".split(), "fr": "le des où été élève garçon avec très dans".split()}
    rows = [(i, " ".join(rng.choices(words[lang], k=rng.randint(3, 60))), lang) for i, lang in enumerate(rng.choices(["en", "fr"], k=400))]
    odd = [(1000, None, "en"), (1001, "", "fr"), (1002, "12 34 !!", "en"), (None, "the thing", None), (1003, "日本語" * 200, None), (1004, "the " * 20_000, "en")]
    got = language_id.identify(spark.createDataFrame(rows + odd, "doc_id long, text string, lang string")).collect()
    by_id = {r.doc_id: r for r in got}
    assert len(got) == len(rows) + len(odd)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got if r.doc_id is not None)
    held = [(by_id[i].lang_pred, lang) for i, _, lang in rows if by_id[i].held_out]
    assert len(held) > 40 and sum(a == b for a, b in held) == len(held)
    assert all((by_id[i].lang_pred, by_id[i].score, by_id[i].rejected) == ("und", 0.0, True) for i in (1000, 1001, 1002))
    assert by_id[None].lang_pred == "en" and by_id[1004].lang_pred == "en" and by_id[1003].rejected
    assert not any(by_id[i].rejected for i, _, _ in rows)
    assert all(0 <= r.score <= 1 for r in got)
    assert language_id.identify(empty).collect() == []
    nothing = language_id.identify(spark.createDataFrame([(1, "a b", None)], "doc_id long, text string, lang string")).collect()
    assert nothing[0].lang_pred == "und"


def test_language_id_against_brute_force(spark):
    """Weights, cosines and rejections recomputed from the words alone; centroids where their texts say."""
    rng = random.Random(8)
    words = {"en": "the of and thing with was here that on under".split(), "de": "der die und nicht mit für über wäre daß".split()}
    rows = [(i, " ".join(rng.choices(words[lang], k=rng.randint(5, 80))), lang) for i, lang in enumerate(rng.choices(["en", "de"], k=300))]
    odd = [(900, "zzz qqq xxx jjj", None), (901, "The 12 THING!", None), (902, None, None), (903, "…", "en")]
    frame = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string")
    model, got = language_id.learned(frame), {r.doc_id: r for r in language_id.identify(frame).collect()}

    def features(text):
        raw = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in f" {text.lower()} ".encode())
        grams = (raw[i : i + 3] for i in range(len(raw) - 2))
        return Counter(int.from_bytes(g, "big") * 0x9E3779B1 % 2**32 >> 20 for g in grams if g != b"   ")

    learned = [(features(t), lang) for i, t, lang in rows if zlib.crc32(str(i).encode()) % 5]
    seen = Counter(f for c, _ in learned for f in c)
    idf = {f: np.log((1 + len(learned)) / (1 + seen[f])) + 1 for f in range(language_id.FEATURES)}
    assert np.allclose(model.idf, [idf[f] for f in range(language_id.FEATURES)])

    def vector(counts):
        v = np.zeros(language_id.FEATURES)
        for f, n in counts.items():
            v[f] = np.log1p(n) * idf[f]
        return v / max(np.linalg.norm(v), 1e-12)

    for k, lang in enumerate(model.languages):
        own = [v for v in (vector(c) for c, x in learned if x == lang) if max((j for j, x in enumerate(model.languages) if x == lang), key=lambda j: v @ model.centroids[j]) == k]
        mean = np.sum(own, axis=0)
        assert len(own) > 1 and mean @ model.centroids[k] / np.linalg.norm(mean) > 0.98
    for i, text, _ in rows + odd:
        if text is None or text == "…":
            assert (got[i].lang_pred, got[i].score, got[i].rejected) == ("und", 0.0, True)
            continue
        counts = features(text)
        cosines = model.centroids @ vector(counts)
        best = int(cosines.argmax())
        assert got[i].lang_pred == model.languages[best] and got[i].score == pytest.approx(min(1, max(0, cosines[best])), abs=1e-5)
        cut = language_id.REACH * model.least[best, int(np.log2(max(1, len(counts))))]
        assert abs(cosines[best] - cut) < 1e-5 or got[i].rejected == (cosines[best] < cut)
    assert got[900].rejected and sum(r.rejected for r in got.values()) <= 5


#: The first words of the declaration of human rights in languages that the documents don't have.
UNLEARNED = [
    "Tutti gli esseri umani nascono liberi ed eguali in dignità e diritti. Essi sono dotati di ragione e di coscienza e devono agire gli uni verso gli altri in spirito di fratellanza.",
    "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto, ja heidän on toimittava toisiaan kohtaan veljeyden hengessä.",
    "Bütün insanlar hür, haysiyet ve haklar bakımından eşit doğarlar. Akıl ve vicdana sahiptirler ve birbirlerine karşı kardeşlik zihniyeti ile hareket etmelidirler.",
    "Alle mensen worden vrij en gelijk in waardigheid en rechten geboren. Zij zijn begiftigd met verstand en geweten, en behoren zich jegens elkander in een geest van broederschap te gedragen.",
    "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem i powinni postępować wobec innych w duchu braterstwa.",
    "Todos os seres humanos nascem livres e iguais em dignidade e em direitos. Dotados de razão e de consciência, devem agir uns para com os outros em espírito de fraternidade.",
]


def test_language_id_rejects_unlearned_languages(spark):
    """Whole and cut, and although a few of their texts are labelled as a learned language."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    rng = random.Random(4)
    alien = UNLEARNED + [t[:60] for t in UNLEARNED] + [" ".join(f"{rng.getrandbits(32):08x}" for _ in range(40))]
    learned = [i for i in range(-100, 0) if zlib.crc32(str(i).encode()) % 5][:4]
    wrong = [(i, UNLEARNED[1] + " " * i, "en") for i in learned]
    more = [(1_000_000 + i, t, None) for i, t in enumerate(alien)] + wrong
    got = language_id.identify(docs.unionByName(spark.createDataFrame(more, docs.schema))).collect()
    stays = {r.doc_id for r in got if not r.rejected}
    assert not stays & {i for i, _, lang in more if lang is None}
    clean = [r.doc_id for r in docs.collect() if r.text and len(r.text) > 40 and not re.search(r"\d", r.text) and zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert len(clean) > 100 and set(clean) <= stays


def test_more_languages_than_a_model_holds_are_refused(spark, monkeypatch):
    rows = spark.createDataFrame([(k, f"some words of text {k}", f"l{k % 4}") for k in range(12)], "doc_id long, text string, lang string")
    assert len(set(language_id.fit(rows, centroids=1).languages)) == 4
    monkeypatch.setattr(language_id, "MAX_LANGUAGES", 3)
    with pytest.raises(ValueError):
        language_id.fit(rows)
