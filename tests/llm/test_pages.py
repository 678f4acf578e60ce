"""URL filter (op 3), WARC archives (op 4), neighbours (op 5) and main text (op 6)."""

import base64
import gzip
import hashlib
import io
from collections import Counter
import os
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracklens.llm import neighbours, urls, warc, wrapper

# ---- urls


def slow_rule(host, path):
    best = None
    for rule, _ in urls.RULES:
        name, rest = rule.split("/", 1)
        if (host == name or host.endswith("." + name)) and path.startswith("/" + rest) and (best is None or len(rule) > len(best)):
            best = rule
    return best


def slow_parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    n = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    path = rest[n:]
    m = min([path.find(c) for c in "?#" if c in path] or [len(path)])
    return "".join(c.lower() if c.isascii() else c for c in rest[:n]), path[:m]


ODD_URLS = [None, "", "no scheme", "http://", "http://NET/", "https://a.net", "https://a.net/", "https://notnet/x", "ftp://EXAMPLE.net/en/1?x#y", "http://example.net/EN/", "x://example.com/de/", "a://b.org/fr/x", "a://b://c.net/",
            "http://u@h.example.net:80/en/", "http://É.net/\nx", "http://a.example.com?q=/de/", "x" * 50_000]


def test_urls_against_brute_force(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", F.lit("x").alias("host"), F.lit(1.0).alias("lm_score"))
    odd = [(10**6 + i, u, "x", 1.0) for i, u in enumerate(ODD_URLS)]
    pages = pages.union(spark.createDataFrame([*odd, *odd[:2], (None, "http://b.org/en/", "x", 1.0)], pages.schema))
    rows = pages.select("page_id", "url").collect()
    got = urls.filter_urls(pages).collect()
    assert len(got) == len(rows)
    by = {r["page_id"]: r for r in got}
    verdict = dict(urls.RULES)
    for page_id, url in rows:
        host, path = slow_parts(url)
        rule = slow_rule(host, path)
        r = by[page_id]
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        assert r["verdict"] == verdict[rule] if rule else r["verdict"] in ("allow", "block")
    assert urls.filter_urls(pages.limit(0)).count() == 0
    free = urls.filter_urls(pages.where("url LIKE '%b.org/en/%'")).collect()
    assert [r["verdict"] for r in free] == ["allow"]  # nothing to learn from


def test_language_model_equals_plain_one():
    taught = ["http://aa.b/x1", "http://ab.b/", "http://aa.c/y22"]
    gram, begins = urls.codes(taught)
    counts = np.bincount(gram, minlength=urls.SIGNS**4).astype(float)
    log = urls.log_model(counts, 2)
    signs = [[int(urls._CODE[b]) for b in u.split("://")[1].encode()] + [0] for u in taught]

    def p(context, sign):
        if context is None:
            return 1 / urls.SIGNS
        seen = {}
        for s in signs:
            full = [0, 0, 0, *s]
            for i in range(3, len(full)):
                if tuple(full[i - len(context) : i]) == context:
                    seen[full[i]] = seen.get(full[i], 0) + 1
        below = p(context[1:] if context else None, sign)
        total, kinds = sum(seen.values()), len(seen)
        return (seen.get(sign, 0) + kinds * below) / (total + kinds) if total >= 2 else below

    for i, s in enumerate(signs):
        full = [0, 0, 0, *s]
        for k in range(len(s)):
            assert np.exp(log[gram[begins[i] + k]]) == pytest.approx(p(tuple(full[k : k + 3]), s[k]))
    assert np.exp(log).reshape(-1, urls.SIGNS).sum(axis=1) == pytest.approx(1)


def test_scores_tell_hosts_apart(spark):
    rows = [(f"http://good{i % 7}.site.org/page/{i}", 1, i % 5) for i in range(200)] + [(f"http://x{i % 9}-casino.biz/win{i}", 0, i % 5) for i in range(200)]
    ratio, threshold = urls.fit(spark.createDataFrame(rows, "url string, kind int, fold int"))
    asked = spark.createDataFrame([("http://good.site.org/page/9999",), ("http://new-casino.biz/win",)], "url string")
    a, b = (r["lm_score"] for r in urls.scored(asked, ratio).collect())
    assert a > threshold > b


# ---- archives


def test_damaged_archives_are_not_read_in_silence(spark, tmp_path):
    rng = np.random.default_rng(2)
    pages = spark.createDataFrame([(i, f"http://a/{i}", "".join(map(chr, rng.integers(32, 127, 900)))) for i in range(12)], "page_id bigint, url string, html string")
    manifest = warc.write_archives(pages.coalesce(1), f"file://{tmp_path}/w")
    [(path, size, records)] = manifest.collect()
    path = path.removeprefix("file://")
    with open(path, "rb") as f:
        whole = f.read()
    assert (len(whole), records) == (size, 12)
    starts = [at for at, _ in warc.members(io.BytesIO(whole), size, 0, size)]

    def read(data, split, damaged="raise"):
        found = [x for lo in range(0, len(data), split) for x in warc.members(io.BytesIO(data), len(data), lo, min(lo + split, len(data)), damaged)]
        return len({at for at, _ in found})

    for split in (300, 2000, 1 << 20):
        for at in (0, starts[3], starts[5] + 1, starts[7] + 40, starts[7] + 600, starts[11], starts[11] + 700, size - 3):  # a header, a body, a checksum
            flipped = whole[:at] + bytes([whole[at] ^ 0x55]) + whole[at + 1 :]
            with pytest.raises(warc.Damaged):
                read(flipped, split)
            assert read(flipped, split, "skip") == 11
        with pytest.raises(warc.Damaged):
            read(whole[:-100], split)
        assert read(whole, split) == 12
    for data in (whole[: starts[9]], whole[: starts[4]] + b"x" + whole[starts[4] + 1 :]):  # whole records, but not all; a spoilt one
        with open(path, "wb") as f:
            f.write(data)
        with pytest.raises(Exception, match="Damaged"):
            warc.read_archives(manifest, 2000).count()


def test_files_of_attempts_that_do_not_count_are_not_read(spark, tmp_path):
    pages = spark.createDataFrame([(i, "u", f"page {i}") for i in range(6)], "page_id bigint, url string, html string")
    first = warc.write_archives(pages, f"file://{tmp_path}/w")
    n = len(list((tmp_path / "w").iterdir()))
    (tmp_path / "w" / "part-000000-999999.warc.gz").write_bytes(b"a draft of a lost attempt")
    assert warc.read_archives(first).count() == 6 and n == first.count()


@pytest.mark.parametrize("split", [1, 97, 10_000, 8 << 20])
def test_archives_round_trip(spark, tmp_path, split):
    rng = np.random.default_rng(5)
    noise = "".join(map(chr, rng.integers(32, 0x2FF, 3000)))
    rows = [(5, "http://a/", "<p>x</p>"), (3, None, "<p>x</p>"), (9, "u\r\nv w", "<p>x</p>"), (1, "e", None), (2, "e", ""), (7, "n", noise), (None, "z", "<p>x</p>"), (None, "q", "alone"), (11, "g", "\x1f\x08 WARC/1.1"), (4, "d", "twice"), (4, "d", "twice"), (6, "b", "one id"), (6, "a", "one id"), (6, None, "one id"), (8, "a", "one id")]
    pages = spark.createDataFrame([(*r, "s", 1) for r in rows], "page_id bigint, url string, html string, sha string, first int")
    manifest = warc.write_archives(pages.repartition(3), f"file://{tmp_path}/w")
    got = warc.read_archives(manifest, split, with_payload=True).collect()
    assert len(got) == len(rows)
    first: dict = {}
    for i, _, h in rows:
        if i is not None:
            first[h or ""] = min(first.get(h or "", i), i)
    want, chiefs = [], set()
    for i, u, h in sorted(rows, key=lambda r: (r[1] is not None, r[1] or "")):
        data = (h or "").encode()
        f = first.get(h or "")
        again = f is not None and (i is None or i > f or data in chiefs)  # of rows of the first id that of the least url responds
        if i == f:
            chiefs.add(data)
        want.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if again else "response", f if again else None))
    assert sorted(map(str, ((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got))) == sorted(map(str, want))
    assert {bytes(r["payload"]) for r in got if r["record_type"] == "response"} == {(h or "").encode() for *_, h in rows}
    assert {r["url"] for r in got if r["page_id"] == 9} == {"u%0D%0Av%20w"}
    for r in manifest.collect():  # plain gzip, whole files
        path = r["path"].removeprefix("file://")
        assert os.path.getsize(path) == r["size"] and gzip.open(path).read().count(b"WARC/1.1\r\nWARC-Type") == r["records"]


def test_archives_of_nothing_and_small_payloads(spark, tmp_path):
    empty = spark.createDataFrame([], "page_id bigint, url string, html string")
    assert warc.read_archives(warc.write_archives(empty, f"file://{tmp_path}/e")).count() == 0
    pages = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcd"), (4, "u", "abcd")], "page_id bigint, url string, html string")
    got = warc.read_archives(warc.write_archives(pages, f"file://{tmp_path}/s", min_bytes=3)).collect()
    assert sorted((r["page_id"], r["record_type"]) for r in got) == [(1, "response"), (2, "response"), (3, "response"), (4, "revisit")]


# ---- neighbours


def vectors(spark, rows, kind="float"):
    return spark.createDataFrame(rows, f"vec_id bigint, embedding array<{kind}>, node bigint, block string")


def test_neighbours_equal_brute_force_when_small(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=8).astype(np.float32).tolist(), 1, "b") for i in range(300)]
    rows += [(300 + i, rows[7][1], 1, "b") for i in range(60)]  # copies of one vector
    rows += [(500, [1.0, 2.0], 1, "b"), (501, [0.5] * 11, 1, "b"), (7, [3.0] * 8, 1, "b"), (20, [2.0] * 8, 1, "b"), (40, rows[40][1], 1, "b")]  # short, long, ids that repeat
    usable = [(r[0], np.pad(np.array(r[1]), (0, 11 - len(r[1])))) for r in rows]
    rows += [(400, None, 1, "b"), (420, [0.0] * 8, 1, "b"), (440, [None] + [1.0] * 7, 1, "b"), (460, [float("nan")] + [1.0] * 7, 1, "b"), (480, [float("inf")] + [1.0] * 7, 1, "b"), (520, [], 1, "b"), (None, rows[0][1], 1, "b")]
    found = neighbours.search(vectors(spark, rows, "double"), block=100, passes=3).collect()
    x = np.stack([v for _, v in usable])
    want = Counter()
    for q, (name, v) in enumerate(usable):
        if name % 20 == 0:
            s = x @ v
            want.update((name, k + 1, i, round(-t, 9)) for k, (t, i) in enumerate(sorted((-s[j], usable[j][0]) for j in range(len(usable)) if j != q)[:20]))
    got = Counter((r["query_id"], r["rank"], r["vec_id"], round(r["score"], 9)) for r in found)
    assert got.total() == want.total() and {k[0] for k in got} == {k[0] for k in want}
    assert (got & want).total() >= 0.97 * want.total()


def test_neighbours_recall(spark):
    e = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")  # 31 blocks
    seeds, found = (neighbours.search(e, block=64, **how) for how in ({"descents": 0, "rounds": 0}, {}))
    assert neighbours.recall(e, seeds) < 0.75  # so it is the graph that finds the rest
    assert neighbours.recall(e, found) >= 0.95


def test_neighbours_of_few(spark):
    assert neighbours.search(vectors(spark, [])).count() == 0
    assert neighbours.search(vectors(spark, [(0, [1.0, 0.0], 1, "b")])).count() == 0
    got = neighbours.search(vectors(spark, [(0, [1.0, 0.0], 1, "b"), (1, [1.0, 0.0], 1, "b"), (2, [0.0, 1.0], 1, "b"), (2, [0.0, 1.0], 1, "b")])).orderBy("rank").collect()
    assert [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got] == [(0, 1, 1, 1.0), (0, 2, 2, 0.0), (0, 3, 2, 0.0)]


# ---- main text


def page(i, text, more=""):
    return f"""<!DOCTYPE html><html><head><title>t{i}</title><style>p{{}}</style><script>var a="</p>";</script></head><body class="page">
      <header>Site {i}</header><nav><ul><li><a href="/{i}">menu {i}</a></li><li>b</li></ul></nav><div class="ad">buy {i}</div><div class="cookie-notice">We use cookies</div>
      {more}<article><header><h1>Head {i}</h1></header><p><b>{text} &amp; more<br><p>Second&nbsp;&eacute;
      line <!-- c -->here<div class="comments"><p>first! {i}</p></div><aside>see {i}</aside><form><input value="x"><button>go</button></form></article>
      <aside class="sidebar">side {i}</aside><footer>&copy; {i}</footer></body></html>"""


def main(html):
    root, blocks = wrapper.parse(html)
    wrapper.slots(root)
    return wrapper.content(root, blocks, set())


def test_main_text_of_one_page():
    assert main(page(1, "Hello <i>big</i>world")) == "Head 1\nHello bigworld & more\nSecond é line here"
    assert main("") == "" and main("just text") == "just text" and main("<p>a<p>b") == "a\nb"
    assert main('<div title="a>b">x</div><div title="y>z') == "x\nz"
    assert main("<ul><li>a<li>b</ul><table><tr><td>c<td>d</table>") == "a\nb\nc\nd"
    assert main("<div>" * 3000 + "deep" + "</div>" * 3000) == "deep"
    assert main("a<p>" + "x " * 100_000) == "a\n" + ("x " * 100_000).strip()


def test_names_do_not_drop_articles():
    for open_, close in (("<body class='has-sidebar'>", "</body>"), ("<article class='post comments-open'>", "</article>"), ("<div id='content' class='no-ads'>", "</div>"), ("<main class='widget-area'>", "</main>"),
                         ("<div class='page sidebar'><div id='left-menu'><article>", "</article></div></div>"), ("<body id=search><div role=main class=comments>", "</div></body>")):
        assert main(f"{open_}<p>the article</p>{close}") == "the article"
    for furniture in ("<div class='ad'>x</div>", "<div class='site-footer'>x</div>", "<div id='main-nav'>x</div>", "<div class='widget-area'>x</div>", "<div id='comments'><article>x</article></div>", "<div role='banner'>x</div>"):
        assert main(f"<article><p>the article</p></article>{furniture}") == "the article" == main(f"{furniture}<main><p>the article</p></main>")


def test_elements_that_look_like_others():
    assert main("<article><p>A</p><video-player></video-player><p>B</p></article>") == "A\nB"
    assert main("<article><p>A <math><mi>x</mi><mo>=</mo><mn>1</mn><annotation>x=1</annotation></math> b <math-inline>E</math-inline> c</p></article>") == "A x=1 b E c"
    assert main("<form id='aspnetForm'><article>all of it</article><button>go</button></form>") == "all of it"
    assert main("<article><section id='related-work'><p>r</p></section><p class='social-history'>s</p><section class='share-prices'>p</section></article>") == "r\ns\np"
    assert main("<article><p>a <b>b <i>c</b> d</i> e</p><p>f <b>g</p> h</b> i</article>") == "a b c d e\nf g\nh i"


def test_trees_of_any_depth_and_width_align():
    deep = "<div><p>t</p>" * 3000 + "deep" + "</div>" * 3000
    wide = "".join(f"<h2>{i}</h2><p>{i}</p>" for i in range(100))  # 200 runs: each a slot of its own
    very_wide = "".join(f"<h2>{i}</h2><p>{i}</p>" for i in range(2000))
    for html, n in ((deep, 6001), (wide, 201), (very_wide, 3)):
        tree = wrapper.slots(wrapper.parse(html)[0])
        assert wrapper.load(wrapper.dump(tree)) == tree if html != deep else wrapper.dump(wrapper.load(wrapper.dump(tree))) == wrapper.dump(tree)
        assert wrapper.align(tree, wrapper.load(wrapper.dump(tree))) == {i: i for i in range(n)}


def test_alignment_is_best():
    def brute(a, b):
        if a[0] != b[0]:
            return 0

        def seq(x, y):
            if not x or not y:
                return 0
            return max(seq(x[1:], y), seq(x, y[1:]), brute(x[0], y[0]) + seq(x[1:], y[1:]) if brute(x[0], y[0]) else 0)

        return 1 + seq(a[3], b[3])

    rng = np.random.default_rng(4)

    def tree(depth):
        return ["abc"[rng.integers(3)] if depth < 3 else "r", 0, 0, [tree(depth - 1) for _ in range(rng.integers(0, 4))] if depth else []]

    for _ in range(60):
        a, b = tree(3), tree(3)
        found = wrapper.align(a, b)
        assert len(found) == brute(a, b)
        assert len(set(found.values())) == len(found)
        names = lambda t: [n[0] for n in wrapper.walk(t)]
        assert all(names(a)[i] == names(b)[j] for i, j in found.items())


def test_template_is_induced(spark):
    # the host's own banner has no telling name: only its constancy shows that it is template
    bare = lambda i: f"<html><body><div>Our house banner</div><div class='story'><p>Story number {i}</p><p>and its end {i * 7}</p></div><div>All rights</div></body></html>"
    rows = [(i, "http://h.example/a", bare(i), "x", 1) for i in range(12)] + [(100, "http://few.example/", bare(100), "x", 1), (101, None, None, "x", 1), (None, "http://h.example/b", bare(77), "x", 1), (3, "http://h.example/a", bare(3), "x", 1)]
    rows += [(200 + i, "http://c.example/", page(5, "same text"), "x", 1) for i in range(30)]  # copies of one page
    got = wrapper.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string, host string, slot int")).collect()
    by = {r["page_id"]: r["text"] for r in got}
    assert len(got) == len(rows) and all(r["n_chars"] == len(r["text"]) for r in got)
    assert by[4] == "Story number 4\nand its end 28" and by[None] == "Story number 77\nand its end 539"
    assert by[100] == "Our house banner\nStory number 100\nand its end 700\nAll rights" and by[101] == ""
    assert by[205].startswith("Head 5\nsame text")
    assert wrapper.extract(spark.createDataFrame([], "page_id bigint, url string, html string")).count() == 0


def test_template_of_other_pages_than_the_first(spark):
    banner = "<div>Our house banner</div>"
    story = lambda i, more="": f"<html><body>{banner}{more}<div class='story'><p>Story number {i}</p></div><div>All rights</div></body></html>"
    second = lambda i: f"<html><body><table><tr><td>Second house</td></tr></table><ul><li>Item {i}</li></ul><h6>Imprint</h6></body></html>"
    rows = []
    for h, first in (("null", None), ("empty", ""), ("error", "<h1>502 Bad Gateway</h1>")):  # the smallest page_id is no usual page
        rows += [(h, 0, first)] + [(h, i, story(i)) for i in range(1, 12)]
    rows += [("two", i, second(i) if i % 3 == 0 else story(i)) for i in range(24)]
    # what the first page lacks, and a slot where the first page has a text of its own
    rows += [("lacks", i, story(i, "<p>Read our new book</p>" if i % 2 else "")) for i in range(30)]
    rows += [("own", i, story(i).replace("All rights", "Hello") if i == 0 else story(i)) for i in range(20)]
    # a name's part is overruled where the text varies
    rows += [("named", i, f"<body>{banner}<div class='page-banner'><p>Words {i}</p></div><div class='top-banner'>All the same</div></body>") for i in range(10)]
    ids = {(h, i): k for k, (h, i, _) in enumerate(rows)}
    table = spark.createDataFrame([(ids[h, i], f"http://{h}/", t) for h, i, t in rows], "page_id bigint, url string, html string")
    by = {r["page_id"]: r["text"] for r in wrapper.extract(table).collect()}
    got = {k: by[v] for k, v in ids.items()}
    assert [got["null", 0], got["empty", 0], got["error", 0]] == ["", "", "502 Bad Gateway"]
    want = {(h, i): f"Words {i}" if h == "named" else f"Item {i}" if h == "two" and i % 3 == 0 else f"Story number {i}" for h, i in got}
    want["own", 0] = "Story number 0\nHello"
    assert {k: v for k, v in got.items() if k[1] or k[0] in ("two", "lacks", "own", "named")} == {k: v for k, v in want.items() if k[1] or k[0] in ("two", "lacks", "own", "named")}


def test_main_text_of_the_test_pages(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    docs = {" ".join(r[0].split()) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").where("text IS NOT NULL").select("text").collect()}
    got = wrapper.extract(pages).collect()
    assert len(got) == pages.count()
    assert all(" ".join(r["text"].split("\n")[1:]) in docs for r in got)  # all after the heading is a document
