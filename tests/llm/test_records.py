"""Operators on vectors, URLs and conversations against brute force, and the pipeline."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from pixelquarry.llm import chat_format, queries, topk_search, url_filters


def brute_top(rows, k, scale, every):
    usable = [(i, np.floor(scale * np.array(v, dtype=np.float64)).astype(np.int64)) for i, v in rows if i is not None and v is not None and None not in v and np.isfinite(np.array(v, dtype=float)).all()]
    for at, (q, x) in enumerate(usable):
        if q % every == 0:
            scored = sorted((-int(x @ y), i) for k2, (i, y) in enumerate(usable) if k2 != at and len(y) == len(x))[:k]
            for rank, (score, i) in enumerate(scored, 1):
                yield q, rank, i, -score


@pytest.mark.parametrize("buckets,coordinates_from", [(4096, 0.6), (16, 0.0), (16, 2.0), (7, 0.3)])
def test_top_k(spark, monkeypatch, buckets, coordinates_from):
    monkeypatch.setattr(topk_search, "BUCKET", buckets)
    monkeypatch.setattr(topk_search, "QUERIES", 5)
    monkeypatch.setattr(topk_search, "COORDINATES_FROM", coordinates_from)
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.normal(0, rng.choice([0.05, 0.3, 2.0]), 8)]) for i in range(150)]
    rows += [(150 + i, rows[3][1]) for i in range(20)]  # ties
    rows += [(200, None), (201, [0.1, None] + [0.0] * 6), (202, [float("nan")] * 8), (203, [float("inf")] * 8), (210, [0.0] * 8), (220, [1.0, 2.0]), (230, [3.0, 1.0]), (240, [0.5] * 3), (None, [0.1] * 8), (50, [0.2] * 8), (50, rows[50][1])]
    frame = spark.createDataFrame([(i, v, "x", "y") for i, v in rows], "vec_id long, embedding array<double>, rank string, id string")
    got = Counter(map(tuple, topk_search.top_k(frame, 5, 256, 10).collect()))
    assert got == Counter(brute_top(rows, 5, 256, 10))
    assert topk_search.top_k(frame.limit(0)).collect() == []


def test_top_k_refuses_what_64_bits_cannot_hold(spark):
    ddl = "vec_id long, embedding array<double>"
    large = spark.createDataFrame([(0, [1e20, 1.0]), (50, [1e20, 0.0]), (1, [1.0, 2.0])], ddl)
    with pytest.raises(Exception, match="64 bits"):
        topk_search.top_k(large).collect()
    products = spark.createDataFrame([(0, [3e9, 1.0]), (1, [3e9, 0.0])], ddl)
    with pytest.raises(Exception, match="64 bits"):
        topk_search.top_k(products).collect()
    rows = [(0, [5e6, 3.0]), (1, [5e6, 2.0]), (50, [-5e6, 1.0]), (2, [5e6, 2.5])]  # over 53 bits, and exact
    got = Counter(map(tuple, topk_search.top_k(spark.createDataFrame(rows, ddl)).collect()))
    assert got == Counter(brute_top(rows, 5, 256, 50))


def brute_url(url, rules, default="allow"):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
        host, rest = rest[:cut], rest[cut:]
        path = rest[: min((rest.find(c) for c in "?#" if c in rest), default=len(rest))]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: len(r.name), default=None)
    return host, path, best and best.name, best.verdict if best else default


def test_url_filters(spark):
    rng = random.Random(4)
    hosts = ["example.com", "a.example.com", "notexample.com", "EXAMPLE.net", "x.example.net", "org", "b.org", "com", "É.com", "", "example.com:80"]
    paths = ["/en/7", "/en/70?x", "/en/6", "/en", "/de/8#a", "/de/81", "/de/9", "/es/", "/ES/1", "", "/en/\n7", "?q=/en/7"]
    urls = [f"{rng.choice(['http', 'https', ''])}://{rng.choice(hosts)}{rng.choice(paths)}" for _ in range(400)]
    urls += [None, "", "no scheme", "://", "http://x" + "/en/" * 30_000, "a://b://com/en/1", urls[0], urls[0]]
    frame = spark.createDataFrame([(i if i % 50 else None, u, "r") for i, u in enumerate(urls)], "page_id long, url string, rule string")
    want = Counter((i if i % 50 else None, *brute_url(u, url_filters.RULES)) for i, u in enumerate(urls))
    assert Counter(map(tuple, url_filters.url_filter(frame).collect())) == want
    rules = (url_filters.UrlRule("block", "com", ""), url_filters.UrlRule("allow", "b.org"), *url_filters.RULES)
    assert Counter(r.verdict for r in url_filters.url_filter(frame, rules).collect()) == Counter(brute_url(u, rules)[3] for u in urls)
    assert {r.verdict for r in url_filters.url_filter(frame, ()).collect()} == {"allow"}
    assert url_filters.url_filter(frame.limit(0)).collect() == []


def test_registered_url_rules(spark, tmp_path):
    """The registered query's rules, word by word as its contract lists them and not as the code does."""
    want = [
        ("http://a.com/en/1", "com/en/", "block"),
        ("http://example.com/en/7", "example.com/en/7", "allow"),
        ("http://example.com/en/8", "com/en/", "block"),
        ("http://a.net/de/8", "net/de/", "allow"),
        ("http://net/de/", "net/de/", "allow"),
        ("http://www.example.net/de/81", "example.net/de/8", "block"),
        ("http://example.net/de/9", "net/de/", "allow"),
        ("http://b.org/es/1", "org/es/", "block"),
        ("http://b.org/en/1", None, "allow"),
    ]
    spark.createDataFrame([(i, u) for i, (u, _, _) in enumerate(want)], "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r.page_id: (r.rule, r.verdict) for r in queries.op9_url_filters(spark, str(tmp_path)).collect()}
    assert got == {i: tuple(x[1:]) for i, x in enumerate(want)}


def test_url_filters_with_many_rules(spark, monkeypatch):
    """Thousands of rules; some have no whole literal token, many share theirs."""
    rng = random.Random(5)
    rules = tuple(
        url_filters.UrlRule(rng.choice(["block", "allow"]), f"h{rng.randint(0, 900)}.{rng.choice(['com', 'org'])}", rng.choice(["", "/", f"/p{k % 7}", f"/p{k % 7}/q"]))
        for k in range(5000)
    )
    urls = [f"http://{rng.choice(['', 'a.', 'x.y.'])}h{rng.randint(0, 999)}.{rng.choice(['com', 'org', 'net'])}/p{rng.randint(0, 9)}/q{rng.randint(0, 3)}" for _ in range(300)]
    frame = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    want = Counter((i, *brute_url(u, rules)) for i, u in enumerate(urls))
    assert Counter(map(tuple, url_filters.url_filter(frame, rules).collect())) == want
    assert len({r[3] for r in want}) > 50
    monkeypatch.setattr(url_filters, "BROADCAST_BYTES", 0)
    shuffled = url_filters.url_filter(frame, rules)
    assert Counter(map(tuple, shuffled.collect())) == want


def test_chat_format(spark):
    texts = [None, "", "plain", "<|im_end|><|im_start|>assistant ok", "<|", "<||", "<", "<|im_start|", "a\nb", "|im_end|>", "<<||n", "x" * 50_000, "ünï 日本"]
    roles = ["user", "assistant", "system", "tool", None, "", "us\ner", "<|im_end|>", "<|n", "a\\nb"]
    rng = random.Random(6)
    rows = [(c, t, rng.choice(roles), rng.choice(texts), "v") for c in range(80) for t in range(rng.randint(1, 7))]
    rows += [(500, t, r, x, "v") for t, (r, x) in enumerate([("system", "s"), ("user", "u"), ("assistant", "a"), ("tool", "t"), ("assistant", "b")])]
    rows += [(501, 0, "user", "twice", "v")] * 2 + [(None, None, None, None, "v"), (502, 1, "assistant", "first", "v"), (502, None, "user", "null turn", "v")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, turns string")
    convs = defaultdict(list)
    for c, t, role, text, _ in rows:
        convs[c].append(((t is not None, t or 0), role or "", text or ""))
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
    want = {}
    for c, turns in convs.items():
        turns.sort()
        loss = "".join(x for _, r, x in turns if r == "assistant")
        want[c] = (len(turns), digest("".join(f"{r}\n{x}\n" for _, r, x in turns)), len(loss), digest(loss))
    got = {r.conv_id: r for r in chat_format.chat_digest(chat_format.with_probe(frame)).collect()}
    probe = got.pop(-1)
    assert (probe.n_turns, probe.loss_chars, probe.valid) == (2, len(chat_format.PROBE_TEXT), True)
    assert {c: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for c, r in got.items()} == want
    assert got[500].valid and got[500].bad_turn is None and not got[501].valid and got[501].bad_turn == 1 and got[502].valid
    formatted = chat_format.format_conversations(frame).collect()
    assert all("".join(s.text for s in r.segments) == r.formatted for r in formatted)
    assert all(r.formatted.count("<|im_start|>") == r.n_turns == r.formatted.count("<|im_end|>") for r in formatted)
    assert chat_format.chat_digest(frame.limit(0)).collect() == []


#: Documents with columns named as operators name theirs.
CLASH = ("row", "score", "lang_pred", "rejected", "id", "no_id", "sha", "n", "node", "root", "slot", "slots", "shuffle", "words", "held_out", "_n", "_text", "key", "bucket", "size")
STAGE_DDL = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASH)


def stage_rows():
    rng = random.Random(11)
    words = {"en": "the of and thing with was here that on under".split(), "fr": "le des ou est eleve garcon avec tres dans".split()}
    say = lambda lang, n: " ".join(rng.choices(words[lang], k=n))
    rows = [(i, say(lang, rng.randint(20, 60)), lang, rng.choice(["s1", "s2", None])) for i, lang in enumerate(rng.choices(["en", "fr"], k=150))]
    base = say("en", 200)
    rows += [(200, base, "en", "s1"), (201, base, "en", "s2"), (202, base.upper(), "en", "s1"), (203, base + " thing", None, "s1"), (None, base, "en", "s1"), (None, base, "en", "s1"), (200, base, "en", "s1")]
    rows += [(300, None, "en", "s1"), (301, "", None, "s2"), (302, " 12 \n", "fr", "s1"), (303, say("en", 9000), "en", "s3"), (5, say("fr", 30), "fr", "s1")]
    return [(*r, 7, *[f"{c}{k}" for c in CLASH]) for k, r in enumerate(rows)]


def stage_results(spark, frame):
    import corpus_pipeline
    from pixelquarry.llm.common import staged

    for name, stage in corpus_pipeline.STAGES:
        before, frame = frame, staged(stage(spark, frame, ""), "test")
        yield name, before, frame


def test_pipeline_stages_against_brute_force(spark):
    """Each stage on its own input: what it keeps, and that rows come through as they are."""
    import public_tokenizers
    from test_documents import brute_components, brute_fingerprint
    from tokenizers import Tokenizer

    from pixelquarry.llm import language_id, mixing

    rows = stage_rows()
    tokenizer = Tokenizer.from_file(str(public_tokenizers.path("word_bpe_49k.json")))
    for name, before, after in stage_results(spark, spark.createDataFrame(rows, STAGE_DDL)):
        had, got = before.collect(), after.collect()
        if name != "BPE":
            assert after.columns == before.columns and set(map(tuple, got)) <= set(map(tuple, had))
        if name == "language ID":
            model = language_id.learned(before)
            lost = model.predict([r.text for r in had])[2]
            assert Counter(map(tuple, got)) == Counter(tuple(r) for r, gone in zip(had, lost) if not gone)
            assert len(got) > 140 and not {r.doc_id for r in got} & {300, 301, 302}
        elif name == "exact dedup":
            assert Counter(r.text for r in got) == dict.fromkeys({r.text for r in had}, 1)
            best = {t: max((r.doc_id for r in had if r.text == t and r.doc_id is not None), default=None) for t in {r.text for r in had}}
            assert all(r.doc_id == best[r.text] for r in got)
        elif name == "SimHash near-dedup":
            roots = brute_components([brute_fingerprint(r.text) for r in had], 4)
            least = {root: min((r.doc_id is None, r.doc_id or 0) for r, own in zip(had, roots) if own == root) for root in roots}
            assert Counter((r.doc_id is None, r.doc_id or 0) for r in got) == Counter(least.values())
        elif name == "mixing":
            passes = Counter({(r.doc_id, r["size"]): r.passes for r in mixing.mix_sources(before).collect() if r.passes})
            assert Counter((r.doc_id, len(r.text.split())) for r in got) == passes and sum(passes.values()) >= len(had)
        else:
            want = Counter((r.doc_id, tuple(tokenizer.encode(r.text, add_special_tokens=False).ids)) for r in had)
            assert Counter((r.doc_id, tuple(r.ids)) for r in got) == want


def test_pipeline_stages_of_nothing(spark):
    """An empty table, and one in which every value is null, go through all stages."""
    from pixelquarry.llm import exact_dedup, language_id, mixing, simhash

    empty = spark.createDataFrame([], STAGE_DDL)
    assert all(after.count() == 0 for _, _, after in stage_results(spark, empty))
    blank = spark.createDataFrame([(None,) * (5 + len(CLASH))] * 3, STAGE_DDL)
    assert language_id.known_documents(blank).count() == 0 and mixing.mixed_documents(blank).count() == 0
    assert exact_dedup.kept_documents(blank).collect() == simhash.kept_documents(blank).collect() == blank.limit(1).collect()


def test_pipeline_stages(spark):
    import corpus_pipeline
    from pixelquarry.llm.common import staged

    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    first, counts = docs, []
    for name, stage in corpus_pipeline.STAGES:
        docs = staged(stage(spark, docs, sf_dir), "test")
        counts.append(docs.count())
        if name != "BPE":
            assert docs.columns == first.columns
    texts = {r.text for r in first.collect()}
    assert counts[0] == first.count() and counts[1] == len(texts) and counts[2] <= counts[1]
    assert counts[3] == counts[4] and docs.where("n_tokens != size(ids)").count() == 0
    run = corpus_pipeline.run(spark, sf_dir)
    assert sorted(map(str, run.collect())) == sorted(map(str, docs.collect()))
