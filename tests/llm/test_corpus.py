"""The corpus operators against brute force, the tokenizer libraries, round trips and edge rows."""

import json
import random
from array import array

import numpy as np
import pytest
from pyspark.sql import functions as F

from oresieve.llm import bpe, chat, components, embed, html, mix, quality, queries, simhash, tokencount, toxicity, urls
from oresieve.llm.shared import Scratch

P = pytest.importorskip("public_tokenizers")
EDGE = [None, "", " \n\t", "one", "a b c d e f g h " * 9, "x" * 5000, "tie tie", "tie tie", "é\x1c\x85漢字 <|endoftext|> ΑΣ don't!!"]


def documents(spark, texts):
    rows = [(k, t, None if k % 3 == 0 else f"s{k % 2}", "clash", "clash") for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, size string, n_tokens string")


def test_tokens_agree_with_the_libraries(spark, monkeypatch):
    from tokenizers import Tokenizer

    byte, word = P.path("byte_bpe_50k.json"), P.path("word_bpe_49k.json")
    mine, counter = bpe.ByteBPE(open(byte, "rb").read()), tokencount.WordCounter(open(word, "rb").read())
    a, b = Tokenizer.from_file(byte), Tokenizer.from_file(word)
    pool = ["a", "the", " ", "  ", "\n", "\x1c", "\xa0", "Σ", "İ", "<|endoftext|>", "<|startoftext|>", "'s", "12", "漢", "😀", "!!", "̀", "aaaa", "\r\n", "K"]
    draw = random.Random(1)
    for _ in range(1500):
        s = "".join(draw.choice(pool) for _ in range(draw.randint(0, 14)))
        ids = a.encode(s, add_special_tokens=False).ids
        assert mine.encode(s) == array("I", ids).tobytes() and mine.decode(mine.encode(s)) == a.decode(ids, skip_special_tokens=False)
        n = len(b.encode(s, add_special_tokens=False).ids)
        assert counter.count(s) == n and (counter.prefix_counts(s, 3) or [0])[-1] == n
    words = ["abcabcabcxyz" * 9, "thethethe" * 20, "zqzqjxkv" * 30]
    wanted = [counter.count(w) for w in words]
    monkeypatch.setattr(tokencount, "MOST_TRANSITIONS", 5)
    counter.transducer.reset()
    assert [counter.transducer.count(w.encode()) for w in words] == wanted == [len(b.encode(w).ids) for w in words] and len(counter.transducer.steps) <= 5
    docs = documents(spark, EDGE)
    got = {r.doc_id: r for r in bpe.encode_decode(docs, byte).collect()}
    assert all(got[k].decoded == (t or "") and len(got[k].ids) // 4 == len(a.encode(t or "", add_special_tokens=False).ids) for k, t in enumerate(EDGE))
    assert {r.doc_id: r.n_tokens for r in tokencount.token_counts(docs, word).collect()} == {k: len(b.encode(t or "", add_special_tokens=False).ids) for k, t in enumerate(EDGE)}
    assert bpe.encode_decode(docs.where("false"), byte).count() == 0 == tokencount.token_counts(docs.where("false"), word).count()


def test_quality_against_windows(spark):
    draw = random.Random(2)
    texts = [*EDGE, *(" ".join(draw.choice("ab" if k % 2 else "abcdefghij") for _ in range(draw.randint(0, 80))) for k in range(60))]
    got = {r.doc_id: r for r in quality.verdicts(quality.quality_counts(documents(spark, texts))).collect()}
    for k, t in enumerate(texts):
        w = (t or "").encode().split()
        seen, cover = {}, set()
        for i in range(len(w) - 7):
            seen.setdefault(tuple(w[i : i + 8]), []).append(i)
        for at in seen.values():
            if len(at) > 1:
                cover.update(j for i in at for j in range(i, i + 8))
        longest = max((n for i in range(len(w)) for j in range(i) for n in [next((x for x in range(len(w) - i) if w[i + x] != w[j + x]), len(w) - i)] if n >= 8), default=0)
        r = got[k]
        assert (r.n_words, r.n_repeat_words, r.longest_repeat) == (len(w), len(cover), longest)
        assert r.base_failed == (len(w) < 20 or 100 * len(cover) > 30 * len(w)) and r.kept == (not r.base_failed and longest <= quality.LONGEST_REPEAT)
    assert quality.keep_good(documents(spark, EDGE).where("false")).count() == 0
    clash = documents(spark, texts).withColumn("N_words", F.lit("clash")).withColumn("kept", F.lit("clash"))
    again = quality.verdicts(quality.quality_counts(clash))
    assert len({c.lower() for c in again.columns}) == len(again.columns) and {r.doc_id: r.n_words for r in again.collect()} == {k: r.n_words for k, r in got.items()}
    assert quality.keep_good(clash).columns == clash.columns


def reach(nodes, edges):
    out = {n: n for n in nodes}
    for _ in nodes:
        for a, b in edges:
            out[a] = out[b] = min(out[a], out[b])
    return out


def test_components(spark):
    draw = random.Random(3)
    edges = [(k, k + 1) for k in range(40)] + [(100, 100 + k) for k in range(1, 30)] + [tuple(draw.sample(range(200, 260), 2)) for _ in range(40)]
    table = spark.createDataFrame([*edges, *((b, a) for a, b in edges), (7, 7), (None, 3)], "a long, b long")
    got = {r.node: r.component for r in components.connected_components(table, Scratch(spark)).collect()}
    assert got == reach({n for e in edges for n in e}, edges)
    words = components.connected_components(table.select(F.col("a").cast("string"), F.col("b").cast("string")), Scratch(spark))
    assert words.select("component").distinct().count() == len({*got.values()})
    assert components.connected_components(table.where("false"), Scratch(spark)).count() == 0


def test_masks_cover_the_radius():
    masks = simhash.covering_masks()
    assert len(masks) == 7 and all(any(not m >> i & 1 and not m >> j & 1 for m in masks) for i in range(64) for j in range(64))


def test_simhash_links(spark, monkeypatch):
    from xxhash import xxh64_intdigest

    draw = random.Random(4)
    base = [" ".join(draw.choice("abcdefghijklmnop") for _ in range(30)) for _ in range(12)]
    texts = [*EDGE, *base, *base[:4], *(b[:-1] + "z" for b in base), *(b.upper() for b in base[:3])]
    docs = documents(spark, texts)

    def fp(t):
        w = (t or "").encode().lower().split()
        s = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) > 2 else [b" ".join(w)] if w else []
        h = [xxh64_intdigest(x, 42) for x in s]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    prints = [fp(t) for t in texts]
    near = [(a, b) for a in range(len(texts)) for b in range(a) if (prints[a] ^ prints[b]).bit_count() <= 2]
    want = reach(range(len(texts)), near)
    for pairwise in (48, 1):
        monkeypatch.setattr(simhash, "PAIRWISE", pairwise)
        got = {r.doc_id: r for r in simhash.near_duplicates(docs).collect()}
        assert {k: r.component_id for k, r in got.items()} == want and all(r.fp % (1 << 64) == prints[k] for k, r in got.items())
    fps = [7, 7 ^ 1, 7 ^ 6, 7 ^ 24, 1 << 63, (1 << 63) ^ 3, 0xFFFF, *(draw.getrandbits(63) for _ in range(20))]
    table = spark.createDataFrame([(simhash._signed(f),) for f in fps], "fp long")
    found = {tuple(sorted((r.a % (1 << 64), r.b % (1 << 64)))) for r in simhash.links(table, Scratch(spark)).collect()}
    true = {tuple(sorted((a, b))) for a in fps for b in fps if a < b and (a ^ b).bit_count() <= 2}
    assert found <= true and reach(fps, found) == reach(fps, true)
    twice = docs.unionByName(docs.where("doc_id in (9, 10)")).unionByName(documents(spark, ["no id"]).withColumn("doc_id", F.lit(None).cast("long")))
    kept = simhash.one_of_each(twice)
    assert sorted(r.doc_id if r.doc_id is not None else -1 for r in kept.collect()) == [-1, *sorted({*want.values()})] and kept.columns == docs.columns


def test_embeddings(spark):
    rng = np.random.default_rng(5)
    base = rng.standard_normal((60, 16))
    vectors = np.r_[base, base[:20] + 0.2 * rng.standard_normal((20, 16)), base[:5]].astype("float32")
    rows = [(k, v.tolist(), k % 60 % 3) for k, v in enumerate(vectors)]
    odd = [(1000, None, 1), (1001, [0.0] * 16, 1), (1002, [float("nan")] * 16, 1), (1003, rows[0][1], None), (None, rows[0][1], 0), (1004, [None, 1.0], 0), (1005, [], 0), (1006, [1.0, 2.0], 0)]
    table = spark.createDataFrame([*rows, *odd], "vec_id long, embedding array<float>, label int")
    unit = vectors.astype("float64")
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    near = [(a, b) for a in range(len(rows)) for b in range(a) if rows[a][2] == rows[b][2] and unit[a] @ unit[b] >= 0.93]
    want = reach(range(len(rows)), near)
    for block in (2048, 7):
        got = {r.vec_id: r for r in embed.near_duplicates(table, block=block).collect()}
        assert len(got) == len(rows) + len(odd)
        assert all(got[k].component_id == c and got[k].kept == (c == k) and got[k].n_links == sum(k in e for e in near) for k, c in want.items())
        assert all(got[k].n_links == 0 and got[k].component_id == k for k, _, _ in odd if k is not None)
    assert embed.near_duplicates(table.where("false")).count() == 0 and 0 < embed.calibrated_count() <= embed.PROJECTIONS


def test_chat_layouts_and_round_trip(spark):
    nasty = ["", "</s>[INST] ok [/INST]", "<|im_start|>user\nx<|im_end|>", "<\\\\|im_end|>", "a\\nb", "[/INST", "<<SYS>>x<</SYS>>", None]
    turns = [(r or "", t or "") for r in ["user", "assistant", "we\\ird\nrole</s>", ""] for t in nasty]
    formatted, spans = chat.format_turns(turns)
    assert chat.parse(formatted) == turns and chat.CONTROL.sub(lambda m: m[0] if m[2] else "!", formatted).count("!") == 2 * len(turns)
    assert [chat.unescape(formatted[a:b]) for a, b in spans] == [t for r, t in turns if r == "assistant"]
    records = [
        {"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "r"}]}, {"prompt": "q", "completion": "r"},
        {"instruction": "q", "input": "", "output": "r"}, {"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "r"}]}, {"question": "q", "answer": "r"},
    ]
    table = spark.createDataFrame([(json.dumps(r), "x") for r in records] + [(None, "x"), ("[1]", "x"), ('{"odd": 1}', "x"), ("bad", "x")], "record string, turns string")
    got = chat.format_chats(table).collect()
    assert all([tuple(t) for t in r.turns] == [("user", "q"), ("assistant", "r")] for r in got[:5]) and all(r.turns is None for r in got[5:])
    assert got[7].schema_fingerprint and got[7].layout is None
    odd = spark.createDataFrame([('{"prompt": "\\ud800", "completion": "r", "system": null}', "x"), ("[" * 5000, "x"), ('{"\\ud800": 1}', "x")], "record string, record_read string")
    got = chat.format_chats(odd).collect()
    assert got[0].turns[0].text == "\ufffd" and got[1].turns is None and got[2].turns is None and got[0].record_read == "x"
    rows = spark.createDataFrame([(1, 1, "assistant", None), (1, 0, None, "hi"), (None, 0, "user", "x")], "conv_id long, turn long, role string, text string")
    digests = {r.conv_id: r.n_turns for r in queries.chat_digests(chat.format_chats(chat.records_of(rows))).collect()}
    assert digests == {1: 2, None: 1}


def test_html(spark):
    page = (
        "<html><head><title>T</title><script>if (a < b) '<p>no</p>'</script></head><body><header>H</header><nav>N</nav><div class='cookie-notice'>C</div>"
        "<aside>S</aside><article class='post'><header><h1>A &amp; B</h1><span>by</span></header><p>one<b> two\n three<br><p>&lt;x&gt;&nbsp;y<ul><li>i<li>j</ul><form>F</form><div class=ad>AD</div>"
        "<section id=comments><p>me</p></section></article><footer>&copy;</footer>"
    )
    assert html.article_text(page) == "A & B\none two three\n<x> y\ni\nj"
    assert html.article_text("") == "" and html.article_text("<p>a<p>b") == "a\nb" and html.article_text("a < b <!-- x --> c") == "a < b c"
    rows = [(k, f"http://h.x/{k}", f"<div><p>Follow us today</p></div><p>text {k}</p>") for k in range(20)] + [(50, None, None), (51, "http://o.x/", "<p>Follow us today</p>")]
    got = {r.page_id: r.text for r in html.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[3] == "text 3" and got[50] == "" and got[51] == "Follow us today"
    assert html.main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_html_names_drop_no_article():
    for around in ("class='content has-sidebar'", "id='page' class='with-menu'", "class='social-science'", "class='sidebar'", "id=widget"):
        assert html.article_text(f"<nav>N</nav><div {around}><article><h1>A</h1><p>b</article></div><footer>F</footer>") == "A\nb"
        assert html.article_text(f"<nav>N</nav><div {around}><main><p>b</main></div>") == "b" == html.article_text(f"<main><div {around}><article>b</article></div></main>")
    for own in ("post has-comments", "post sponsored", "comment", "ad"):
        assert html.article_text(f"<body><nav>N</nav><article class='{own}'><p>b<div class='no-ads'>c</div></article></body>") == "b\nc"
    page = "<div class=x>{}</div><ol class=comment-list><li><article class=comment>me</article></ol><div class='related-posts'><article>R</article></div><div class='ad-slot-3'>AD</div>"
    assert html.article_text(page.format("<article>b</article>")) == "b" and html.article_text(page.format("b")) == "b\nR"
    assert html.article_text(page.format("<article></article>")) == "" and html.article_text("<body class='sidebar'><p>b") == "b"
    assert html.article_text("<article><div class=widget><article>b</article></div></article>") == "b"
    assert html.article_text("<div id=comments><article>b</article></div>") == "b" and html.article_text("<div class='cookie-notice'>C</div><p>b") == "b"


def test_html_head_without_end():
    head = "<html><head>\n<meta charset=utf-8><title>T</title><style>p{}</style><noscript><img src=x>N</noscript>\n"
    for page in ("<body class=x><p>a<p>b", "<p>a<p>b</body>", "<body><article><p>a</p><p>b</p></article>", "a<br><p>b", "<!-- x --><div><p>a</div><p>b"):
        for end in ("", "</head>"):
            assert html.article_text(head + end + page) == "a\nb"
    assert html.article_text("<head><title>T</title><noscript><link href=x><body><p>a") == "a" and html.article_text("<head><title>T</title>") == ""
    assert html.article_text("<p>a<head><p>b") == "a\nb"


def test_html_copies_keep_their_article(spark):
    around = "<nav><p>menu {0}</p></nav><div class=ad><p>buy {0}</p></div>{1}<footer>foot {0}</footer>".format
    box, copy, near = "<div><p>Follow us today</p></div>", "<h1>Title</h1><p>first words of it</p><p>second words of it</p>", "<p>third words of it</p><p>seen {} times</p>"
    hosts = {
        "copies": [f"<article>{copy}<div class=ad>AD {k}</div></article>" for k in range(20)],
        "bare": [copy] * 20,
        "near": [f"<article>{copy}{near.format(k)}</article>" for k in range(20)],
        "mixed": [f"<article>{copy}{box}</article>"] * 20 + [f"<article><p>another text, number {k}</p>{box}</article>" for k in range(15)],
    }
    rows = [(f"{host} {k}", f"http://{host}.x/{k}", around(k, body)) for host, pages in hosts.items() for k, body in enumerate(pages)]
    got = {r.page_id: r.text for r in html.main_text(spark.createDataFrame(rows, "page_id string, url string, html string")).collect()}
    text = "Title\nfirst words of it\nsecond words of it"
    assert all(got[f"{host} {k}"] == text for host in ("copies", "bare", "mixed") for k in range(20))
    assert all(got[f"near {k}"] == f"{text}\nthird words of it\nseen {k} times" for k in range(20))
    assert all(got[f"mixed {20 + k}"] == f"another text, number {k}" for k in range(15))


def test_url_aliases(spark):
    link = '<link rel="canonical" href="{}">'.format
    rows = [
        (1, "http://A.example.com/en/1", None), (2, "https://other.io/x?q#f", link("http://a.example.com/en/1")), (3, "http://third.io/", link("https://other.io/x?q")),
        (4, "http://fourth.io/", link("http://b.example.com/en/7x") + link("http://b.example.com/en/1")), (5, None, ""), (6, "no scheme", ""), (7, "http://q.net/de/8", ""), (8, "http://x.example.net/de/8?z", ""), (1, "http://A.example.com/en/1", None),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("rule", F.lit("clash"))
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.judge(pages, queries.RULES).collect()}
    assert got[1] == ("a.example.com", "/en/1", "com/en/", "block") and got[2] == ("other.io", "/x", None, "block") and got[3][3] == "block"
    assert got[4][3] == "allow" and got[5] == got[6] == ("", "", None, "allow") and got[7][2:] == ("net/de/", "allow") and got[8][2:] == ("example.net/de/8", "block")
    moved = spark.createDataFrame([("http://free.io/", "http://c.org/es/1")], "src string, dst string")
    assert urls.judge(spark.createDataFrame([(9, "http://free.io/", "")], "page_id long, url string, html string"), queries.RULES, redirects=moved).first().verdict == "block"
    assert urls.judge(pages.where("false"), queries.RULES).count() == 0


def test_url_targets_are_decoded_and_resolved(spark):
    bad, two = "http://a.org/es/1", "http://a.org/es/7?page=2&ref=x"
    links = {
        "http://b.io/1": f"<link rel='canonical' href='{two.replace('&', '&amp;')}'>", "http://b.io/2": f"<link rel=canonical href={two}>",
        "http://b.io/3": f"<link href='{bad}' title='a > b' rel='alternate Canonical'>", "http://b.io/4": "<LINK REL=canonical HREF='//a.org/es/1'>",
        "http://c.org/x/1?q": "<link rel=canonical href='/es/1'>", "http://c.org/es2/2": "<meta http-equiv=refresh content='0;URL=../es/1'>",
        "http://b.io/5": "<base href='http://a.org/es/'><link rel=canonical href=1>", "http://b.io/6": f"<meta http-equiv='Refresh' content='3; url=&quot;{bad}&quot;'>",
        "http://b.io/7": f"<meta name=x content='it's'><meta content=0; url={bad} http-equiv=refresh>", "http://b.io/8": "<link rel=canonical href='http://a.org&#47;es/9?a=1&copy=2'>",
    }
    free = {"http://d.io/1": f"<link rel='not-canonical' href='{bad}'>", "http://d.io/2": "<link rel=canonical href='/login?next=http://a.org/es/1'>", "http://d.io/3": f"<link rel=canonical href='mailto:{bad}'>", "http://d.io/4": "<meta http-equiv=refresh content=30>", "no scheme": "<link rel=canonical href='/es/1'>"}
    pages = spark.createDataFrame([*links.items(), *free.items(), ("http://d.io/5", None), (None, "<link rel=canonical href='/'>")], "url string, html string")
    assert {r.url: r.verdict for r in urls.judge(pages, queries.RULES).collect()} == dict.fromkeys(links, "block") | dict.fromkeys([*free, "http://d.io/5", None], "allow")
    assert urls.targets("http://b.io/8", links["http://b.io/8"]) == ["http://a.org/es/9?a=1&copy=2"]
    base = "http://h/a/b/c?q#f"
    wanted = {"../d?x=../y": "http://h/a/d?x=../y", "d/./e/..": "http://h/a/b/d/", "?z": "http://h/a/b/c?z", "/../g": "http://h/g", "../../../g": "http://h/g", " /g\n": "http://h/g", "#s": None, "": None, "x:y": None}
    assert {t: urls.resolve(base, t) for t in wanted} == wanted and urls.resolve("http://h", "g") == "http://h/g" and urls.resolve("https://h", "//i") == "https://i"


def test_toxicity_learns_from_documents(spark):
    draw = random.Random(6)
    plain = ["tree", "house", "river", "stone", "cloud", "green", "walks", "under"]

    def text(bad):
        s = [" ".join(draw.choice(plain) for _ in range(8)) + "." for _ in range(6)]
        if bad:
            s[draw.randrange(6)] = f"you are {draw.choice(['vilelo', 'vileka', 'grubby'])} indeed."
        return " ".join(s)

    rows = [(k, text(k % 4 == 0), int(k % 4 == 0)) for k in range(600)]
    docs = spark.createDataFrame([(k, t, "x") for k, t, _ in rows] + [(9001, None, "x"), (9002, "", "x")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(k, y) for k, _, y in rows] + [(None, 1), (3, None)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    got = {r.doc_id: r for r in toxicity.toxicity(docs, model).collect()}
    out = {r[0] for r in docs.where(toxicity.held_out(F.col("doc_id"))).select("doc_id").collect()}
    assert all((got[k].score >= toxicity.THRESHOLD) == y for k, _, y in rows if k in out) and got[9001].score == got[9002].score == 0
    k, t, _ = rows[0]
    assert "you are" in t[got[k].offending[0].start : got[k].offending[0].end]
    assert toxicity.keep_clean(docs, labels).count() == 452
    clash = docs.unionByName(docs.where("doc_id < 8")).withColumn("l_id", F.lit("x")).withColumn("l_text", F.lit("x")).withColumn("doc", F.lit("x"))
    samples = [toxicity.training_sample(d, labels, Scratch(spark)).collect() for d in (docs, clash)]
    assert sorted(samples[0]) == sorted(samples[1]) and toxicity.keep_clean(clash, labels).columns == clash.columns
    assert toxicity.toxicity(docs, toxicity.train(docs, labels.where("false"))).agg(F.max("score")).first()[0] == 0


def test_mix(spark):
    docs = documents(spark, [*EDGE, *("w " * (k % 7) for k in range(300))])
    rows = mix.mix(docs).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, mix.mix(docs.repartition(7)).collect()))
    by = {}
    for r in rows:
        by.setdefault((r.source_size, r.target), []).append(r.taken)
        assert r.taken <= 3 * r.size
    assert all(abs(sum(t) - target) <= 72 for (_, target), t in by.items())
    assert abs(sum(target for _, target in by) - sum(size for size, _ in by)) < 1e-6
    out = mix.mixed(docs)
    assert out.columns == docs.columns and out.agg(F.sum(mix.word_count("text"))).first()[0] == sum(r.taken for r in rows)
    assert mix.mixed(docs.where("false")).count() == 0
    sizes = spark.createDataFrame([("a", 1), ("b", 1000), (None, 10)], "source string, source_size long")
    goal = {r.source: r.target for r in mix.targets(sizes).collect()}
    assert goal["a"] == 3 and goal[None] == 30 and abs(goal["b"] - 978) < 1e-9


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    draw = random.Random(7)
    clean = [" ".join(draw.choice("abcdefghijklmnopqrstuvwxyz") + str(draw.randrange(900)) for _ in range(40)) for _ in range(60)]
    texts = [*clean, clean[0], "same words " * 40, None]
    spark.createDataFrame([(k, t, "en", f"s{k % 3}", len(t or "")) for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(k, 1, 0) for k in range(9)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in out} <= {*range(60)} and all(r.exact for r in out) and abs(len(out) - 60) <= 3


def test_pipeline_stages_against_plain_computations(spark, tmp_path):
    import hashlib
    from collections import Counter

    import corpus_pipeline
    from tokenizers import Tokenizer
    from xxhash import xxh64_intdigest

    draw = random.Random(8)
    plain = ["tree", "house", "river", "stone", "cloud", "green", "walks", "under"]

    def clean(n=8):
        return " ".join(" ".join(draw.choice(plain) + str(draw.randrange(900)) for _ in range(8)) + "." for _ in range(n))

    toxic = {k for k in range(400) if k % 4 == 0}
    texts = [clean() + (f" you are {draw.choice(['vilelo', 'vileka', 'grubby'])} indeed." if k in toxic else "") for k in range(400)]
    long = [clean(60) for _ in range(10)]
    copies = [texts[1], texts[2].upper(), *long, *(t[: t.rindex(" ")] + f" other{k}." for k, t in enumerate(long))]
    passage = " ".join(clean(26).split()[:205])
    bad = ["too short", "same words " * 40, f"{passage} {clean(150)} {passage}", None, ""]
    fine = [f"{passage[: len(passage) // 2]} {clean(150)} {passage[: len(passage) // 2]}"]
    texts += [*copies, *bad, *fine]
    source = [None if k % 5 == 0 else f"s{k % 3}" for k in range(len(texts))]
    rows = [(k, t, "en", source[k], len(t or "")) for k, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(k, 1, int(k in toxic)) for k in range(300)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))

    def good(t):
        w = (t or "").split()
        at = {}
        for i in range(len(w) - 7):
            at.setdefault(tuple(w[i : i + 8]), []).append(i)
        covered = {j for where in at.values() if len(where) > 1 for i in where for j in range(i, i + 8)}
        windows = [tuple(w[i : i + 201]) for i in range(len(w) - 200)]
        return len(w) >= 20 and 100 * len(covered) <= 30 * len(w) and len({*windows}) == len(windows)

    def fp(t):
        w = t.encode().lower().split()
        h = [xxh64_intdigest(b" ".join(w[i : i + 3]), 42) for i in range(len(w) - 2)]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    left = [{k for k in range(len(texts)) if k not in toxic}]
    left.append({k for k in left[0] if good(texts[k])})
    prints = {k: fp(texts[k]) for k in left[1]}
    near = [(a, b) for a in prints for b in prints if b < a and (prints[a] ^ prints[b]).bit_count() <= 2]
    left.append({*reach(left[1], near).values()})
    assert len(left[0]) - len(left[1]) == len(bad) and any(prints[a] != prints[b] for a, b in near) and len(left[1]) - len(left[2]) > 2
    size = {k: len(texts[k].split()) for k in left[2]}
    names = sorted({source[k] for k in size} - {None}) + [None]
    total = {n: sum(size[k] for k in size if source[k] == n) for n in names}
    weight, rest, open_ = {n: 1 + i % 3 for i, n in enumerate(names)}, float(sum(total.values())), [*names]
    while capped := [n for n in open_ if 3 * total[n] < rest / sum(weight[m] for m in open_) * weight[n]]:
        open_ = [n for n in open_ if n not in capped]
        rest -= sum(3 * total[n] for n in capped)
    taken = Counter()
    for n in names:
        target = rest / sum(weight[m] for m in open_) * weight[n] if n in open_ else 3 * total[n]
        whole, start = int(target // total[n]), 0
        for k in sorted((k for k in size if source[k] == n), key=lambda k: (hashlib.md5(f"9:{k}".encode()).hexdigest(), k)):
            taken[k] = whole + (start + size[k] / 2 <= target - whole * total[n])
            start += size[k]

    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    scratch = Scratch(spark)
    for (name, stage), want in zip(corpus_pipeline.STAGES[:3], left, strict=True):
        docs = scratch.keep(stage(spark, docs, str(tmp_path)), name)
        assert sorted(r.doc_id for r in docs.select("doc_id").collect()) == sorted(want), name
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter(r.doc_id for r in out) == +taken and max(taken.values()) > 1
    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    ids = {k: array("I", library.encode(texts[k], add_special_tokens=False).ids).tobytes() for k in +taken}
    assert all(r.exact and bytes(r.ids) == ids[r.doc_id] and r.n_tokens == len(r.ids) // 4 and r.ids_sha256 == hashlib.sha256(r.ids).hexdigest() for r in out)
