"""The numbered operators against brute force, exact round trips and held-out labels, on small tables with every awkward case."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib

import pytest
import xxhash
from pyspark.sql import functions as F

from evidora.llm import decontaminate, html_text, mixing, quality, registry, simhash, substring, topk, toxicity, urlfilter, warc

WORDS = "river wall stone boat count gull hill rain walk town bring watch over under north south".split()
DOC = "doc_id long, text string, lang string, source string, n_chars long, fp long, key string"


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(("", "s", "ed", str(rng.randrange(99)))) for _ in range(n))


def documents(spark, rows):
    """Rows of (doc_id, text) as documents, with columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), 7, "k") for i, t in rows], DOC)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(3)
    passage = sentence(rng, 30)
    rows = [(i, sentence(rng, rng.randrange(5, 120))) for i in range(60)]
    rows += [(100 + i, t + " end") for i, t in rows[:6]] + [(200 + i, t) for i, t in rows[:4]]
    rows += [(300 + i, sentence(rng, 10) + " " + passage + " " + sentence(rng, 9)) for i in range(8)]
    rows += [(400, ""), (401, None), (402, "   "), (403, "one"), (None, rows[0][1]), (404, "é" * 40 + passage), (405, "word " * 3000), (405, "word " * 3000), (3, "another text with the same id " + passage)]
    rng.shuffle(rows)
    return rows


def test_mixing_meets_its_targets(spark):
    rng = random.Random(1)
    rows = [(i, sentence(rng, 20), "en", "big" if i % 10 else ("small" if i % 20 else None), 0, 0, "") for i in range(2000)] + [(9000, "", "en", "empty", 0, 0, ""), (9001, None, "en", "empty", 0, 0, ""), (None, "a b c", "en", "big", 0, 0, "")]
    rows += rows[:1]
    docs = spark.createDataFrame(rows, DOC)
    got = mixing.mixture(docs, target_entropy=0.9, max_repetition=3.0)
    by = {r.source: r for r in got.groupBy("source").agg(F.sum("tokens").alias("n"), F.max("weight").alias("w"), F.max("epoch").alias("e"), F.max("progress").alias("p")).collect()}
    assert set(by) == {"big", "small", None}
    total = sum(r.n for r in by.values())
    weights = [r.w for r in by.values()]
    entropy = -sum(w * math.log(w) for w in weights) / math.log(3)
    assert math.isclose(sum(weights), 1, abs_tol=1e-9) and max(r.e for r in by.values()) <= 3
    own = {s: sum(len(r[1].split()) for r in rows if r[1] and r[3] == s) for s in by}
    for s, r in by.items():
        quota = round(r.w * sum(own.values()))
        assert quota - 45 <= r.n <= quota  # within a document, of which the repeated one is the longest
        assert quota / own[s] <= 3.0 + 1e-3
    assert entropy >= 0.9 - 1e-3 or max(round(r.w * sum(own.values())) / own[s] for s, r in by.items()) > 2.99
    assert total <= sum(own.values())
    full = got.where("source is null and epoch = 0").count()
    assert full == sum(1 for r in rows if r[3] is None) - 1  # a pass holds every document once, the repeated rows together
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, mixing.mixture(docs, target_entropy=0.9, max_repetition=3.0).collect()), key=repr)
    totals = mixing.units(docs).groupBy(F.col("source").alias("of")).agg(F.sum("tokens").alias("tokens"))
    natural = totals.collect()
    whole = sum(r.tokens for r in natural)
    even = lambda t: -sum(w * math.log(w) for w in [x / sum((r.tokens / whole) ** t for r in natural) for x in [(r.tokens / whole) ** t for r in natural]]) / math.log(len(natural))
    t = mixing.exponent(totals)
    assert 0 < t < 1 and math.isclose(even(t), (even(1) + 1) / 2, abs_tol=1e-6)  # half-way between the natural and the greatest entropy
    again = mixing.mix(docs.withColumn("mix_epoch", F.lit("clash")))
    assert again.schema["mix_epoch"].dataType.simpleString() != "string" and again.count() == mixing.mix(docs).count()
    out = mixing.mix(docs)
    assert out.columns == docs.columns + ["mix_weight", "mix_epoch", "mix_progress"] and out.where("text is null or text = ''").count() == 0
    assert mixing.mixture(docs.where("false")).count() == 0
    assert mixing.mixture(docs.where("source = 'big'")).agg(F.max("weight")).first()[0] == 1.0


def test_blocks_cover_a_source_of_any_size(spark):
    docs = documents(spark, [(i, "a b c d") for i in range(500)])
    got = mixing.passes(docs, block_tokens=64)
    assert got.count() == 500 and got.select("progress").distinct().count() == 500


def test_top_k_against_brute_force(spark):
    rng = random.Random(5)
    rows = [(i, [rng.randrange(-3, 4) / 7 for _ in range(6)]) for i in range(120)]
    rows += [(200, [0.5, None, 0.0, 0.0, 0.0, 0.0]), (250, None), (300, [float("nan")] * 6), (350, [float("inf")] + [0.0] * 5), (None, [9.0] * 6), (50, rows[50][1]), (400, [1.0, 2.0]), (450, [])] + [(500 + i, [0.1] * 6) for i in range(9)]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<double>, score long")
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in topk.top_k(df, F.col("vec_id") % 50 == 0).collect())
    use = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    want = []
    for q, v in use:
        if q is not None and q % 50 == 0:
            best = sorted(((-sum(a * b for a, b in zip(v, w)), i is None, i or 0) for i, w in use if i != q))[:5]
            want += [(q, k + 1, None if none else i, -s) for k, (s, none, i) in enumerate(best)]
    assert got == sorted(want, key=repr) or got == sorted(want, key=lambda r: (r[0], r[1]))
    few = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<double>")
    assert [tuple(r) for r in topk.top_k(few, F.col("vec_id") == 0).collect()] == [(0, 1, 1, 256 * 512)]
    assert topk.top_k(few.where("false"), F.col("vec_id") == 0).count() == 0


def test_html_of_many_shapes(spark):
    model = html_text.TreeModel()
    cases = {
        "<article><p>a &lt;b&gt; &#233;&amp;amp;<br>y\n  z</article>": "a <b> é&amp; y z",
        "<body><nav><a href=x>menu</a></nav><article><h1>T</h1><p>Hello there, this is all.</p><div class='comments'><p>A long and nice comment, thanks.</p></div></article><footer>&copy; x</footer>": "T\nHello there, this is all.",
        "<script>var a='</p>'</script><style>p{}</style><!-- <p>no</p> -->": "", "": "", "<p>": "", "</div></p><b": "",
        "<main><h1>T</h1><p>Body text that is long enough to be main text.</p><form><label>Name</label><input></form><div class='cookie-banner'>We use cookies to help you.</div></main>": "T\nBody text that is long enough to be main text.",
        "<article><ul><li>one thing<li>two things</ul><table><tr><td>x<td>y</table></article>": "one thing\ntwo things\nx\ny",
    }
    rows = [(i, "u", h, "clash") for i, h in enumerate(cases)] + [(None, None, None, "clash")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = {r.page_id: r for r in html_text.main_text(df, model).collect()}
    assert [got[i].text for i in range(len(cases))] == list(cases.values()) and got[None].text == ""
    assert all(r.n_chars == len(r.text) for r in got.values())
    assert html_text.main_text(df.where("false"), model).count() == 0
    deep = "<div>" * 3000 + "<p>x</p>"
    model.extract(deep)


def test_marginals_are_those_of_all_assignments():
    """Sum-product messages against the sum over all assignments of states to the nodes of two trees."""
    import numpy as np

    model = html_text.TreeModel()
    pages = [html_text.parse("<body><div class=menu><p>x</p></div><article><p>Some text.</p></article></body>"), html_text.parse("<p>y<p>z")]
    rng = np.random.default_rng(4)
    forest = html_text.Forest(pages)
    own = rng.normal(size=(forest.size, 3))
    got = forest.marginals(own, model.pair, model.prior)[:, html_text.MAIN]
    own[forest.text, html_text.MIXED] = -np.inf
    pair, at = np.exp(model.pair), 0
    for nodes in pages:
        n = len(nodes)
        mine, parent = np.exp(own[at:at + n]), [-1 if x.parent is None else nodes.index(x.parent) for x in nodes]
        main, whole = np.zeros(n), 0.0
        for code in range(3**n):
            s = [code // 3**i % 3 for i in range(n)]
            w = math.exp(model.prior[s[0]]) * math.prod(mine[i][s[i]] for i in range(n)) * math.prod(pair[s[parent[i]]][s[i]] for i in range(1, n))
            whole += w
            main += w * (np.array(s) == html_text.MAIN)
        assert np.allclose(main / whole, got[at:at + n], atol=1e-9)
        at += n


@pytest.mark.parametrize("name,label,mod,left_out", [("op4_quality_classifier", "quality", 3, 1), ("op5_toxicity", "toxic", 5, 0)])
def test_classifiers_on_held_out_labels(spark, name, label, mod, left_out):
    sf = "/root/testdata/sf0.01"
    rows = registry.queries()[name](spark, sf).collect()
    labels = {r.doc_id: r[label] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % mod == left_out) and r.predicted == int(r.score >= 0.5) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out and r.doc_id in labels]
    assert len(rows) == 1000 and sum(r.predicted == labels[r.doc_id] for r in held) / len(held) > 0.93


@pytest.mark.parametrize("score,columns", [(quality.quality_scores, "doc_id long, quality int"), (toxicity.toxicity_scores, "doc_id long, toxic int")])
def test_classifiers_with_awkward_rows(spark, corpus, score, columns):
    docs = documents(spark, corpus)
    rng = random.Random(2)
    labels = spark.createDataFrame([(i, rng.randrange(2)) for i in range(60)] + [(None, 1), (5, None), (7, 1), (7, 0)], columns)
    got = score(docs, labels).collect()
    assert len(got) == len(corpus) and all(0 <= r.score <= 1 for r in got)
    assert {r.held_out for r in got if r.doc_id is None} == {False}
    one = score(docs, labels.where(labels[1] == 1)).select("score").distinct().collect()
    assert [r.score for r in one] == [1.0]
    assert {r.score for r in score(docs, labels.where("false")).collect()} == {0.5}
    assert score(docs.where("false"), labels).count() == 0


def test_toxic_words_with_inserted_characters():
    rng = random.Random(4)
    clean = [sentence(rng, 40) for _ in range(120)]
    bad = [f"{sentence(rng, 20)} {rng.choice(('numbskull', 'blockhead', 'dimwit'))} {sentence(rng, 20)}" for _ in range(120)]
    model = toxicity.ToxicityModel(toxicity.fit_weights(clean[:100] + bad[:100], toxicity.np.repeat([0.0, 1.0], 100)))
    worst = lambda *t: model.worst(toxicity.pa.array(t))[:, 0]
    calm = worst(*clean[100:]).max()
    assert worst(*bad[100:]).min() > calm and worst("you n.u.m.b.s.k.u.l.l")[0] > calm and worst("d i m w i t indeed")[0] > calm and worst("blocckhead")[0] > calm


def test_url_rules_and_hosts(spark):
    urls = ["https://A.Example.COM/en/7x?q", "http://sub.example.net/de/8/1", "ftp://x.net/de/1#t", "http://b.org/es/", "nothing", None, "", "http://notexample.com/en/7", "://h/p", "http://com/en/", "http://c.fr?x#y", "http://x.net/de/1"]
    rows = [(i, u, "clash") for i, u in enumerate(urls)] + [(None, urls[0], "clash")] + [(100 + i, f"http://s{i}.org/es/{i}", "c") for i in range(30)] + [(200 + i, f"http://t{i}.net/de/{i}", "c") for i in range(30)]
    got = {r.page_id: r for r in urlfilter.filter_urls(spark.createDataFrame(rows, "page_id long, url string, text string")).collect()}
    assert len(got) == len(rows)
    assert (got[0].host, got[0].path, got[0].rule, got[0].verdict) == ("a.example.com", "/en/7x", "example.com/en/7", "allow") and got[None].rule == got[0].rule
    assert [(got[i].rule, got[i].verdict) for i in (1, 2, 3, 7, 9)] == [("example.net/de/8", "block"), ("net/de/", "allow"), ("org/es/", "block"), ("com/en/", "block"), ("com/en/", "block")]
    assert [(got[i].host, got[i].path, got[i].rule) for i in (4, 5, 6, 8, 10)] == [("", "", None), ("", "", None), ("", "", None), ("h", "/p", None), ("c.fr", "", None)]
    assert all(r.verdict in ("allow", "block") for r in got.values())
    none = urlfilter.filter_urls(spark.createDataFrame([(1, "http://a.b/c")], "page_id long, url string")).collect()
    assert none[0].verdict == "allow"


def test_gram_ratios_against_the_formula(spark):
    counts = {"\x02\x02\x02\x02a": (3, 1), "\x02\x02\x02ab": (2, 1), "\x02\x02\x02ac": (1, 0), "xx\x02ab": (0, 4)}
    df = spark.createDataFrame([(g, *c) for g, c in counts.items()], "gram string, a long, r long")
    wanted = list(counts) + ["zzzzz", "zz\x02ab"]
    got = {r.gram: r.ratio for r in urlfilter.gram_ratios(spark.createDataFrame([(g,) for g in wanted], "gram string"), df).collect()}
    for g in wanted:
        p = [1 / 256, 1 / 256]
        for k in range(1, 6):
            for side in (0, 1):
                n = sum(c[side] for h, c in counts.items() if h[-k:] == g[-k:])
                context = sum(c[side] for h, c in counts.items() if k == 1 or h[-k:-1] == g[-k:-1])
                p[side] = (n + 2.0 * p[side]) / (context + 2.0)
        assert math.isclose(got[g], math.log(p[0]) - math.log(p[1]), abs_tol=1e-9)


def test_archives_round_trip(spark, monkeypatch):
    big = "<p>" + "é x\r\n\r\nWARC/1.1\r\n" * 20
    rows = [(5, "http://a b\n", big), (2, None, big), (9, "u", big), (7, "u", None), (8, "u", ""), (1, "u", "small"), (3, "u", "small"), (None, "u", big), (2, "v", big)]
    got = warc.archive_round_trip(spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, digest string")).collect()
    sha = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    want = sorted(((i, len((h or "").encode()), sha(h), "response" if i == 2 or len(h or "") < 100 else "revisit", None if i == 2 or len(h or "") < 100 else 2) for i, _, h in rows), key=repr)
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=repr) == want
    assert warc.archive_round_trip(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
    monkeypatch.setattr(warc, "HOT_COPIES", 1)
    monkeypatch.setattr(warc, "SIZE_CLASSES", (100, 400))
    monkeypatch.setattr(warc, "FILE_BYTES", 800)
    again = warc.archive_round_trip(spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, digest string")).collect()
    assert sorted(map(tuple, again), key=repr) == sorted(map(tuple, got), key=repr)
    records = [("http://x/ y", b"abc\n\nURL 1"), ("z", b"")]
    for version in (1, 2):
        back = list(warc.parse_arc(warc.write_arc(records, version)))
        assert [c for _, c in back] == [c for _, c in records] and back[0][0]["URL"] == "http://x/%20y"
    with pytest.raises(ValueError):
        list(warc.parse_arc(warc.write_arc(records, 1)[:-8]))


def test_repeated_substrings_against_brute_force(spark, corpus):
    got = {}
    for r in substring.dedup_digest(documents(spark, corpus)).collect():
        got.setdefault(r.doc_id, []).append((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256))
    starts: dict = {}
    for i, t in corpus:
        b = (t or "").encode()
        for p in range(len(b) - 49):
            if i is not None:
                starts[b[p:p + 50]] = min(i, starts.get(b[p:p + 50], i))
    want = {}
    for i, t in corpus:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - 49):
            if i is not None and starts[b[p:p + 50]] < i:
                gone[p:p + 50] = b"\1" * 50
        runs = len(re.findall(b"\1+", bytes(gone)))
        want.setdefault(i, []).append((len(b), sum(gone), runs, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
    kept = substring.remove_repeats(documents(spark, corpus))
    assert kept.columns == documents(spark, corpus).columns and kept.count() == len(corpus)
    assert kept.where("n_chars != coalesce(length(text), 0) and text is not null").count() == 0
    assert substring.dedup_digest(documents(spark, corpus).where("false")).count() == 0


def test_merged_transforms_sort_all_windows():
    rng = random.Random(6)
    base = bytes(rng.choice(b"ab") for _ in range(400))
    segments = [base[a:a + 50 + rng.randrange(40)] for a in range(0, 300, 7)]
    at, interval = substring.merge_transforms(segments)
    text = b"".join(s + b"\xff" for s in segments)
    cyclic = {}
    start = 0
    for s in segments:
        ring = (s + b"\xff") * 3
        for p in range(len(s) + 1):
            cyclic[start + p] = ring[p:p + 50]
        start += len(s) + 1
    ordered = [cyclic[p] for p in at.tolist()]
    assert sorted(at.tolist()) == list(range(len(text))) and ordered == sorted(ordered)
    assert all((a == b) == (x == y) for a, b, x, y in zip(ordered, ordered[1:], interval.tolist(), interval.tolist()[1:]))


def test_one_hot_key_is_carried_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(substring, "BLOCK_ROWS", 3)
    passage = "the very same passage of more than fifty bytes in every document, again and again"
    rows = [(i, f"{i} {passage} {i * i}") for i in range(40)]
    got = {r.doc_id: r.n_removed for r in substring.dedup_digest(documents(spark, rows)).collect()}
    assert got[0] == 0 and all(got[i] >= len(passage) for i in range(1, 40))


def test_no_task_holds_a_hot_key(spark, corpus, monkeypatch):
    judged = substring.removed_windows

    def bounded(table, carried):
        keys = table.column("key").to_pylist()
        if max(map(keys.count, keys)) > 6:
            raise ValueError("a task has all segments of a hot key")
        return judged(table, carried)

    passage = "shared words of the passage 0123"
    rows = [(i, t) for i, t in corpus if t != "word " * 3000] + [(1000 + i, f"{i * i} own start {i % 3} {passage} {i % 5} {i * 7} own end of this row, {'-' * (i % 50 + 60)}") for i in range(60)]
    digest = lambda parts: sorted(map(tuple, substring.dedup_digest(documents(spark, rows).repartition(parts)).collect()), key=repr)
    want = digest(2)
    monkeypatch.setattr(substring, "HOT_ROWS", 6, raising=False)
    monkeypatch.setattr(substring, "removed_windows", bounded)
    assert digest(2) == want
    assert digest(48) == want  # a task has about one row of the passage


def test_leaks_against_plain_alignment(spark):
    rng = random.Random(8)
    items = [(i, sentence(rng, 12)) for i in range(12)] + [(90, "short"), (91, None), (92, ""), (94, "7 / 3"), (95, "Yes"), (96, "yes"), (97, "s")]
    items += [(93, items[0][1].upper())]

    def edited(text, n):
        s = list(text)
        for _ in range(n):
            p = rng.randrange(len(s))
            s[p:p + 1] = rng.choice(([], ["#"], [s[p], "q"]))
        return "".join(s)

    rows = [(i, f"{sentence(rng, 15)} {edited(items[i % 12][1], i % 11)} {sentence(rng, 5)}") for i in range(48)] + [(60, None), (61, ""), (None, items[1][1]), (62, sentence(rng, 40)), (63, "yes"), (64, "eyes and yesterday 17 / 3 shorts"), (65, "it is 7  /\n3, Yes! yes."), (66, "a short one " + "word " * 250_000 + "yes")]
    got = {(r.doc_id, r.item_id): r.edits for r in decontaminate.leaks(documents(spark, rows), spark.createDataFrame([(*x, 1) for x in items], "item_id long, text string, edits int")).collect()}
    want = {}
    for i, t in rows:
        for j, u in items:
            a, b = decontaminate.normalise(u), decontaminate.normalise(t)
            if i == 66 and len(a) >= 8:
                continue  # over a million characters: too many for the plain alignment, and it holds none of these
            if len(a) < 8 or not b:
                if a and b and re.search(rf"(?<![^\W_]){re.escape(a)}(?![^\W_])", b):
                    want[i, j] = 0
                continue
            row = [0] * (len(b) + 1)
            for x in range(1, len(a) + 1):
                new = [x]
                for y in range(1, len(b) + 1):
                    new.append(min(row[y - 1] + (a[x - 1] != b[y - 1]), row[y] + 1, new[-1] + 1))
                row = new
            if min(row) <= min(len(a) // 10, (len(a) - 8) // 8):
                want[i, j] = min(row)
    assert got == want and len(want) > 20 and {(63, 95), (63, 96), (65, 94), (66, 90), (66, 96)} <= set(want)
    kept = decontaminate.remove_leaks(documents(spark, rows), spark.createDataFrame(items, "item_id long, text string"))
    assert sorted(map(str, (r.doc_id for r in kept.collect()))) == sorted(str(i) for i, _ in rows if i not in {k for k, _ in want})
    assert decontaminate.leaks(documents(spark, rows), spark.createDataFrame([], "item_id long, text string")).count() == 0


def test_many_blocks_of_items_and_grams_that_many_share(spark, monkeypatch):
    rng = random.Random(11)
    common = "the answer to this question is "
    items = [(i, common * 3 + sentence(rng, 8)) for i in range(40)]
    rows = [(i, f"{sentence(rng, 6)} {items[i][1] if i % 2 else common * 2} {sentence(rng, 5)}") for i in range(30)]
    docs, bench = documents(spark, rows), spark.createDataFrame(items, "item_id long, text string")
    find = lambda: sorted((r.doc_id, r.item_id, r.edits) for r in decontaminate.leaks(docs, bench).collect())
    want = find()
    assert {(i, i, 0) for i in range(1, 30, 2)} <= set(want) and not {d for d, _, _ in want} & set(range(0, 30, 2))
    monkeypatch.setattr(decontaminate, "INDEX_CHARS", 600)
    monkeypatch.setattr(decontaminate, "PAIRS", 50)
    assert find() == want
    assert sorted(r.doc_id for r in decontaminate.remove_leaks(docs, bench).collect()) == list(range(0, 30, 2))


def fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    grams = [" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_near_duplicates_against_brute_force(spark, corpus):
    got = sorted(((r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicates(documents(spark, corpus)).collect()), key=repr)
    prints = [(i, fingerprint(t)) for i, t in corpus]
    group = list(range(len(prints)))
    for a in range(len(prints)):
        for b in range(a):
            if (prints[a][1] ^ prints[b][1]).bit_count() <= 4:
                old, new = group[a], group[b]
                group = [new if g == old else g for g in group]
    least = {}
    for (i, _), g in zip(prints, group):
        least[g] = min(x for x in (least.get(g), i) if x is not None) if (least.get(g) is not None or i is not None) else None
    assert got == sorted(((i, f"{f:016x}", least[g]) for (i, f), g in zip(prints, group)), key=repr)
    kept = simhash.keep_one(documents(spark, corpus)).collect()
    assert sorted(r.doc_id for r in kept if r.doc_id is not None) == sorted(x for x in least.values() if x is not None) and sum(r.doc_id is None for r in kept) == 1
    assert simhash.near_duplicates(documents(spark, corpus).where("false")).count() == 0


def test_vantage_point_shards_lose_no_pair(monkeypatch):
    import numpy as np

    rng = np.random.default_rng(1)
    centres = rng.integers(0, 2**63, 40, dtype=np.uint64)
    fps = np.unique(np.r_[[c ^ (np.uint64(1) << np.uint64(rng.integers(64))) ^ (np.uint64(1) << np.uint64(rng.integers(64))) for c in centres for _ in range(12)], rng.integers(0, 2**63, 500, dtype=np.uint64)]).astype(np.uint64)
    monkeypatch.setattr(simhash, "BLOCK", 64)
    tree, leaves = simhash.build_tree(fps[::3], 4)
    assert leaves > 8
    leaf, at, home = simhash.route(tree, fps, 4)
    group = list(range(len(fps)))

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for n in range(leaves):
        own = at[leaf == n]
        up = simhash.link_near(fps[own], home[leaf == n], 4)
        for i, r in enumerate(up.tolist()):
            a, b = root(own[i]), root(own[r])
            group[max(a, b)] = min(a, b)
    want = list(range(len(fps)))
    for i in range(len(fps)):
        for j in np.flatnonzero(np.bitwise_count(fps[i] ^ fps[:i]) <= 4).tolist():
            old, new = want[i], want[j]
            want = [new if g == old else g for g in want]
    same = lambda g: {frozenset(i for i, x in enumerate(g) if x == r) for r in set(g)}
    assert sorted(home.tolist()).count(True) == len(fps) and same([root(i) for i in range(len(fps))]) == same(want)


def test_a_large_shard_and_a_dense_one(monkeypatch):
    """Random fingerprints with planted neighbours, and near copies of one, against all pairs; the shard's own tree and the blocks of bits both act."""
    import numpy as np

    rng = np.random.default_rng(2)
    flip = lambda c, n: c ^ np.bitwise_or.reduce(np.uint64(1) << rng.choice(64, n, replace=False).astype(np.uint64))
    spread = rng.integers(0, 2**63, 3000, dtype=np.uint64)
    near = np.array([flip(c, rng.integers(1, 7)) for c in spread[:600]])
    dense = np.array([flip(spread[0], rng.integers(1, 5)) for _ in range(1500)])
    fps = np.unique(np.r_[spread, near, dense])
    monkeypatch.setattr(simhash, "BOTTOM", 500)
    monkeypatch.setattr(simhash, "BLOCK", 4096)
    home = rng.random(len(fps)) < 0.6
    up = simhash.link_near(fps, home, 4)
    least = np.arange(len(fps))
    for _ in range(60):
        before = least.copy()
        for i in range(len(fps)):
            j = np.flatnonzero((np.bitwise_count(fps[i] ^ fps) <= 4) & (home[i] | home))
            least[j] = np.minimum(least[j], least[i])
            least[i] = min(least[i], least[j].min(initial=least[i]))
        if (before == least).all():
            break
    assert (up == least).all() and len(np.unique(up)) < len(fps) - 1400


def test_shards_dealt_in_pairs_of_blocks(spark, corpus, monkeypatch):
    want = sorted(map(tuple, simhash.near_duplicates(documents(spark, corpus)).collect()), key=repr)
    monkeypatch.setattr(simhash, "GROUP", 8)
    monkeypatch.setattr(simhash, "HOT_ROWS", 1)
    assert sorted(map(tuple, simhash.near_duplicates(documents(spark, corpus)).collect()), key=repr) == want


def test_visits_of_random_fingerprints():
    import numpy as np

    fps = np.random.default_rng(3).integers(0, 2**63, 40000, dtype=np.uint64)
    visits = []
    for depth in (3, simhash.depth_for(16_000_000)):
        tree, leaves = simhash.build_tree(fps[:20000], depth)
        leaf, at, home = simhash.route(tree, fps, 4)
        visits.append(len(at) / len(fps))
        assert leaves == 2**depth and home.sum() == len(fps)
    assert visits[0] < 3.5 and visits[1] < 5


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i + 1, i) for i in range(60)] + [(100, 99), (99, 99)], "u long, v long")
    got = {r.node: r.root for r in simhash.components(edges).collect()}
    assert got == {**{i: 0 for i in range(61)}, 99: 99, 100: 99}
