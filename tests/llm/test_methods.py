"""The operators' methods on edge rows and against brute force: templates, state maps, cuts, repeats, rules and the noisy-or."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from oresieve.llm import bpe, embed, html, mix, quality, shared, simhash, tokencount, toxicity, urls

P = pytest.importorskip("public_tokenizers")


def page(draw, k, article):
    links = "".join(f"<li><a href=/{draw.random()}>{draw.choice('abcdefgh') * 5}</a></li>" for _ in range(draw.randint(2, 9)))
    return f"<html><body><div class=x1><ul>{links}</ul></div><div class=x2>{article}</div><div class=x3>All rights</div></body></html>"


def test_templates_by_counting(spark):
    draw = random.Random(4)
    rows = []
    for host, n in (("a.x", 40), ("b.x", 14), ("c.x", 11)):
        for k in range(n):
            body = f"<h1>t {host} {k}</h1><p>own {draw.random()}</p>" + ("<p>often</p>" if k % 3 == 0 else "")
            rows.append((len(rows), f"http://{host.upper()}/{k}", page(draw, k, body), "clash", "clash"))
    rows += [rows[0], (900, None, None, None, None), (901, "http://b.x/", "", "", "")]
    table = spark.createDataFrame(rows, "page_id long, url string, html string, text string, host string")
    pages = defaultdict(dict)
    for _, url, h, *_ in rows:
        root = html.parse(h or "")
        marks = html.mark(root)
        pages[(url or "://").split("://")[1].split("/")[0].lower()][html._article(root)[2]] = set(marks)
    wanted = {}
    for host, own in pages.items():
        n = Counter(m for marks in own.values() for m in marks)
        if len(own) >= html.LEAST_PAGES and (found := {m for m, c in n.items() if c >= html.LEAST_PAGES and c >= html.LEAST_SHARE * len(own)}):
            wanted[host] = found
    got = html.site_templates(table.withColumn("host", urls.host_of(F.col("url"))), shared.Scratch(spark)).collect()
    assert {r.host: set(r.templates) for r in got} == wanted and {*wanted} == {"a.x", "b.x"}
    for lists in (True, False):
        out = html.main_text(table, lists=lists)
        assert out.columns == ["page_id", "url", "html", "host", "text", "n_chars"]
        seen = sorted((r.page_id, r.text, r.n_chars) for r in out.collect())
        plain = [(k, html.article_text(h or "", wanted.get((u or "://").split("://")[1].split("/")[0].lower(), set()), lists)) for k, u, h, *_ in rows]
        assert seen == sorted((k, t, len(t)) for k, t in plain)
    texts = {k: t for k, t, _ in seen}
    assert texts[0].startswith("t a.x 0\nown 0.") and texts[0].endswith("often") and "All rights" not in texts[0] and "All rights" in texts[len(rows) - 4] and texts[900] == ""
    few = {r.page_id: r.text for r in html.main_text(table, least_pages=5).collect()}
    assert "All rights" not in few[60] and "All rights" in texts[60]
    assert html.main_text(table.where("false")).count() == 0


def test_html_keeps_what_only_sounds_like_a_template():
    inside = "<article><div class='share-price'>Shares fell 3%</div><p class='notice-period'>np</p><section id='related-work'>rw</section></article>"
    assert html.article_text(inside) == "Shares fell 3%\nnp\nrw"
    assert html.article_text("<article><header><h1>T</h1><p>lead</p><span>by</span></header><p>x</p></article>") == "T\nlead\nx"
    assert html.article_text("<div><p>" + "long body " * 30 + "</p></div><article><p>teaser</p></article>").startswith("long body")
    assert html.article_text("<article>one<aside>a</aside>two</article>") == "one\ntwo"
    links = "<ul><li><a>x</a></li></ul>"
    assert html.mark(html.parse(f"<article>{links}</article>")) != html.mark(html.parse(f"<div>{links}</div>"))
    deep = html.article_text("<div>" * 30_000 + "x" + "</div>" * 30_000)
    assert deep == "x" and len(html.article_text("<article>" + "<p>a <b>b</b> c</p>" * 20_000 + "</article>")) == 20_000 * 6 - 1


def test_token_chunks_compose():
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    counter, library = tokencount.WordCounter(open(path, "rb").read()), Tokenizer.from_file(path)
    draw = random.Random(8)
    pool = ["a", "the", " ", "\n", "\x1c", "Σ", "İ", "<|endoftext|>", "'s", "'re", "'", "ll", "12", "漢字かな", "한국어", "😀", "!!", "̀", "x1y2", "zz", "ABC"]
    for _ in range(1500):
        text = "".join(draw.choice(pool) for _ in range(draw.randint(0, 18)))
        n = len(library.encode(text, add_special_tokens=False).ids)
        assert n == counter.count(text) == counter.count(text, 3) == counter.count(text, 5), text
    for text in ("漢字" * 60_000, "ab" * 60_000, "QmFzZTY0" * 9_000, "=" * 70_000, "word " * 20_000):
        assert counter.count(text) == len(library.encode(text, add_special_tokens=False).ids)
        maps = counter.maps(text)
        assert len(maps) == len(counter.cuts(text, tokencount.CHUNK_CHARS)) and tokencount.composed(maps)(tokencount.START)[1] == tokencount.scan(maps)[-1](tokencount.START)[1]


def mixed_by_hand(rows, goals):
    """taken by (doc_id, size) over a plain sort of each source."""
    out = Counter()
    for source, (target, size) in goals.items():
        whole = int(target // size) if size else 0
        at, rest = 0, target - whole * size
        for _, _, doc, n in sorted((r for r in rows if r[1] == source), key=lambda r: (r[0], r[3])):
            out[doc, source, n] += n * (whole + (n > 0 and at + n / 2 <= rest))
            at += n
    return out


def test_mix_cuts_against_a_plain_sort(spark):
    import hashlib

    draw = random.Random(2)
    docs = [(k if k % 9 else 7, None if k % 13 == 0 else "w " * draw.randint(0, 30), None if k % 5 == 0 else f"s{k % 3}", draw.random()) for k in range(4000)]
    table = spark.createDataFrame(docs, "doc_id long, text string, source string, code double")
    got = mix.mix(table)
    goals = {r[0]: (r[1], r[2]) for r in table.select("doc_id", "source").distinct().join(got, "doc_id").where("doc_id <> 7").select("source", "target", "source_size").distinct().collect()}
    rows = [(hashlib.md5(f"9:{k}".encode()).hexdigest(), s, k, len((t or "").split())) for k, t, s, _ in docs]
    sizes = Counter()
    for _, s, _, n in rows:
        sizes[s] += n
    goals = {s: (t, n) for s, (t, n) in goals.items() if sizes[s] == n}
    wanted, seen = Counter(), Counter()
    for (doc, _, n), taken in mixed_by_hand(rows, goals).items():
        wanted[doc, n] += taken
    for r in got.collect():
        seen[r.doc_id, r.size] += r.taken
    assert {*goals} == {None, "s0", "s1", "s2"} and {k: v for k, v in wanted.items() if k[0] != 7} == {k: v for k, v in seen.items() if k[0] != 7}
    assert abs(sum(wanted.values()) - sum(seen.values())) <= 30 * len(goals) and sum(sizes.values()) == sum(n for *_, n in rows)
    words = mix.mixed(table).agg(F.sum(mix.word_count("text"))).first()[0]
    assert words == sum(seen.values()) and mix.mixed(table).columns == table.columns


def test_mix_splits_equal_rows(spark):
    same = [(1, "a b c", "x")] * 9000 + [(None, "a b c", "x")] * 500 + [(2, "q " * 30_000, "y"), (3, None, None)]
    table = spark.createDataFrame(same, "doc_id long, text string, source string").repartition(5)
    got = mix.mix(table)
    assert got.count() == len(same) and got.groupBy().agg(F.sum(F.col("copies"))).first()[0] == mix.mixed(table).count()
    taken = {r.source_size: (r.t, r.target) for r in got.groupBy("source_size", "target").agg(F.sum("taken").alias("t")).collect()}
    assert all(abs(t - target) <= 1.5 for n, (t, target) in taken.items() if n == 28_500)
    assert sorted(map(str, got.collect())) == sorted(map(str, mix.mix(table.repartition(3)).collect()))


def test_repeats_against_pairs(monkeypatch):
    monkeypatch.setattr(quality, "SPLIT", 16)
    monkeypatch.setattr(quality, "RUN", 4)
    draw = random.Random(3)
    for _ in range(60):
        texts = [[draw.randrange(3) for _ in range(draw.randint(0, 60))] for _ in range(draw.randint(1, 4))]
        n = [len(t) for t in texts]
        words = np.array([w for t in texts for w in t], np.int32)
        doc, ends = np.repeat(np.arange(len(texts)), n), np.repeat(np.cumsum(n), n)
        got = quality.repeats(words, doc, ends, 3).tolist()
        wanted = []
        for t in texts:
            for i in range(len(t)):
                best = 0
                for j in range(len(t)):
                    k = 0
                    while i != j and max(i, j) + k < len(t) and t[i + k] == t[j + k]:
                        k += 1
                    best = max(best, k)
                wanted.append(best if best >= 3 else 0)
        assert got == wanted
    long = "a b c d e f g h i j k l m n o p " * 20_000
    assert quality.count_texts([long])["n_repeat_words"][0] == 320_000


def test_rules_are_a_table(spark):
    rules = [urls.rule(f"h{k}.x/p{k % 5}/", k % 2 == 0) for k in range(3000)] + [urls.rule("x/", False), urls.rule("h7.x/p2/q", True), urls.rule("b.x/", True), urls.rule("b.x/", True)]
    draw = random.Random(5)
    pages = [(k, draw.choice([f"https://s.h{draw.randrange(3100)}.x/p{draw.randrange(6)}/q{k}", f"http://{draw.choice(['b.x', 'bb.x', 'y', 'X', ''])}/p2/", None, "no"]), "x", "x") for k in range(600)]
    table = spark.createDataFrame(pages, "page_id long, url string, rules string, rule_host string")
    got = {r.page_id: r for r in urls.judge(table, rules, html=None).collect()}
    for k, url, *_ in pages:
        host, path = (url.split("://")[1].split("/", 1) if url and "://" in url else ("", ""))
        host, path = host.lower(), "/" + path
        fits = [r for r in rules if host and (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        best = min(fits, key=lambda r: (-len(r.name), r.name), default=None)
        assert (got[k].rule, got[k].verdict) == ((best.name, "allow" if best.allow else "block") if best else (None, "allow")), url


def test_noisy_or_and_its_slopes():
    draw = np.random.default_rng(1)
    owner, row = np.array([0, 0, 1, 2, 2, 2]), np.array([0, 0, 1, 2, 3, 3, 4, 5])
    column, count = np.array([0, 1, 2, 0, 1, 2, 3, 3]), np.array([1.0, 2, 1, 1, 3, 1, 2, 1])
    y, w = np.array([1.0, 0, 1, 0]), draw.uniform(0.3, 2, 4)

    def loss(w):
        total = 0.0
        for d in range(len(y)):
            clear = 1.0
            for s in np.flatnonzero(owner == d):
                odds = sum(w[c] * n for c, n, r in zip(column, count, row, strict=True) if r == s)
                clear *= 1 - min(float(toxicity.chance(odds)), 1 - 1e-9)
            total -= np.log(1 - clear) if y[d] else np.log(clear)
        return total / len(y)

    got = toxicity.slopes(w, column, count, row, owner, y)
    wanted = [(loss(w + e) - loss(w - e)) / 2e-6 for e in np.eye(4) * 1e-6]
    assert np.allclose(got, wanted, atol=1e-5)
    weights = {"=bad": 4.0, "=vile": 3.0}
    score, spans = toxicity.score(toxicity.Model(weights).word, "All is well. A bad day! Vile and bad.\nBad")
    parts = [float(toxicity.chance(x)) for x in (4.0, 7.0, 4.0)]
    assert np.isclose(score, 1 - np.prod([1 - p for p in parts])) and [p for *_, p in spans] == parts
    assert toxicity.counted("bad. bad vile x. ok", 1, {"=bad": 0, "=vile": 1}, 2).sentences == [{0: 1, 1: 1}]


def test_ids_of_any_type(spark):
    rows = [(f"d{k}", "you are vilelo indeed." if k % 4 == 0 else "tree house river.", int(k % 4 == 0)) for k in range(400)]
    docs, labels = spark.createDataFrame(rows, "doc_id string, text string, toxic int").drop("toxic"), spark.createDataFrame(rows, "doc_id string, text string, toxic int").drop("text")
    assert toxicity.keep_clean(docs, labels).count() == 300
    vectors = [("b", [1.0, 0.0], 1), ("a", [1.0, 0.1], 1), ("c", [0.0, 1.0], 1), ("c", [0.0, 1.0], 1), (None, [1.0, 0.0], 1), ("z", None, 1), ("y", [1.0, 0.0], None)]
    table = spark.createDataFrame(vectors, "vec_id string, embedding array<float>, label int").withColumn("e", F.lit("x")).withColumn("component", F.lit("x"))
    got = sorted(map(str, embed.near_duplicates(table).collect()))
    assert got == sorted(
        f"Row(vec_id={a!r}, n_links={n}, component_id={c!r}, kept={k})" for a, n, c, k in (("b", 1, "a", False), ("a", 1, "a", True), ("c", 1, "c", True), ("c", 1, "c", True), (None, 0, None, True), ("z", 0, "z", True), ("y", 0, "y", True))
    )


def test_sorted_projections_miss_no_link():
    draw = np.random.default_rng(7)
    centres = draw.standard_normal((200, 48))
    vectors = np.concatenate([centres[draw.integers(0, 200, 500)] + draw.standard_normal((500, 48)) * s for s in (0.1, 0.25, 0.35)])
    unit = embed._unit(vectors)
    wanted = {(int(a), int(b)) for a, b in zip(*np.nonzero(np.triu(unit @ unit.T >= embed.THRESHOLD, 1)), strict=True)}
    assert {(int(a), int(b)) for x, y in embed.linked_pairs(vectors, vectors, same=True) for a, b in zip(x, y, strict=True)} == wanted and len(wanted) > 500
    left, right = vectors[:700], vectors[700:]
    across = {(int(a), int(b) - 700) for a, b in wanted if a < 700 <= b}
    assert {(int(a), int(b)) for x, y in embed.linked_pairs(left, right) for a, b in zip(x, y, strict=True)} == across


def test_scratch_needs_a_shared_folder(spark, monkeypatch):
    scratch = shared.Scratch(spark)
    kept = scratch.keep(spark.range(3).toDF("x"), "t")
    assert kept.count() == 3 and kept._scratch.startswith(shared.session_folder(spark))
    scratch.drop(kept)
    with pytest.raises(Exception):
        spark.read.parquet(kept._scratch)

    class Elsewhere:
        class conf:
            get = staticmethod(lambda *_: None)

        class sparkContext:
            master = "spark://host:7077"

    with pytest.raises(ValueError):
        shared.shared_folder(Elsewhere)


def test_long_texts_and_clashing_columns(spark):
    from tokenizers import Tokenizer

    from oresieve.llm import bpe, chat, simhash

    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    texts = ["word " * 60_000, "漢字" * 100_000, "x" * 300_000, "a b c d e f g h\n" * 20_000, None, "", "tie", "tie"]
    rows = [(k, t, "clash") for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string").withColumn("decoded", F.lit(1)).withColumn("fp", F.lit(1)).withColumn("q_kept", F.lit(1)).withColumn("score", F.lit(1))
    got = {r.doc_id: r for r in bpe.encode_decode(docs, P.path("byte_bpe_50k.json")).collect()}
    for k, t, _ in rows:
        assert np.frombuffer(got[k].ids, "<u4").tolist() == library.encode(t or "", add_special_tokens=False).ids and got[k].decoded == (t or "")
    assert {r.doc_id: r.component_id for r in simhash.near_duplicates(docs).collect()} == {0: 0, 1: 1, 2: 2, 3: 3, 4: 4, 5: 4, 6: 6, 7: 6}
    assert [r.doc_id for r in quality.keep_good(docs).collect()] == []
    assert sorted(r.doc_id for r in simhash.one_of_each(docs).select("doc_id").collect()) == [0, 1, 2, 3, 4, 6]
    turns = spark.createDataFrame([(1, 0, "user", "a"), (1, 0, "user", "a"), (1, 1, "assistant", "</s>" * 50_000), (2, 0, "user", None)], "conv_id long, turn long, role string, text string")
    said = {r.conv_id: r for r in chat.format_chats(chat.records_of(turns)).collect()}
    assert [tuple(t) for t in said[1].turns] == [("user", "a"), ("user", "a"), ("assistant", "</s>" * 50_000)] and chat.parse(said[1].formatted) == [tuple(t) for t in said[1].turns]
    pages = spark.createDataFrame([(1, "http://a.org/es/1", "<p>x" * 300_000 + "<link rel=canonical href='http://b.y/1'>"), (2, "http://b.y/1", None)], "page_id long, url string, html string")
    assert {r.page_id: r.verdict for r in urls.judge(pages, [urls.rule("org/es/", False)]).collect()} == {1: "block", 2: "block"}
    assert {r.page_id: r.n_chars for r in html.main_text(pages).collect()} == {1: 2 * 300_000 - 1, 2: 0}


def test_long_texts_are_taken_in_runs():
    draw = random.Random(12)
    texts = ["", " ", "a", "a b", " A b\tc ", "x" * 40, "a " * 30, "a\n\n b  c\x1cd\xa0e"]
    texts += ["".join(draw.choice("aB \n\x1c\xa0\u3000.'s12") for _ in range(draw.randint(1, 60))) for _ in range(400)]
    coder = bpe.ByteBPE(shared.file_bytes(P.path("byte_bpe_50k.json")))
    weight = {"a": 1.0, "b": -0.5, "ab": 2.0}.get
    for t in texts:
        for size in (1, 5, 17):
            assert simhash._fingerprint(t, size) == simhash._fingerprint(t)
            assert coder._part(t, size) == coder._part(t)
            runs = [w for run in toxicity.word_runs(t, 0, len(t), size) for w in run]
            assert runs == t.split()
        assert toxicity.score(lambda w: weight(w.lower(), 0.0), t)[0] >= 0
