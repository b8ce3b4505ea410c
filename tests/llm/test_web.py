"""WARC archives and page texts: round trips and odd pages."""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import json
import random
import sys
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from rowaccord.llm import html_text as h
from rowaccord.llm import warc

ROWS = [
    (1, "http://a/x y", "<p>one</p>"), (2, "http://a/2", "<p>one</p>"), (3, None, None), (4, "http://a/4", ""), (5, "u", "é\r\n\r\nWARC/1.1 \n" * 900),
    (6, "u", "alone"), (7, "u", "twice"), (7, "u", "twice"), (None, "u", "<p>one</p>"), (None, "u", "only"),
]


@pytest.fixture
def pages(spark):
    return spark.createDataFrame([(*r, "c", 1) for r in ROWS], "page_id bigint, url string, html string, digest string, n int").repartition(3)


@pytest.mark.parametrize(("least", "per_file"), [(0, 5000), (0, 2), (6, 5000)])
def test_round_trip(pages, monkeypatch, least, per_file):
    monkeypatch.setattr(warc, "RECORDS_PER_FILE", per_file)
    monkeypatch.setattr(warc, "RECORDS_PER_READ", 2)
    largest = {}
    for i, _, t in ROWS:
        if i is not None:
            largest[t or ""] = max(largest.get(t or "", i), i)
    shared = [t or "" for _, _, t in ROWS]
    want = []
    for i, _, t in ROWS:
        data = (t or "").encode()
        revisit = shared.count(t or "") > 1 and len(data) >= least and i != largest[t or ""]
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        want.append((i, len(data), digest, "revisit" if revisit else "response", largest[t or ""] if revisit else None, None if revisit else data))
    got = warc.archived(pages, least).collect()
    key = lambda r: tuple(map(str, r))
    assert sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["type"], r["refers_to"], r["payload"] and bytes(r["payload"]) or (None if r["payload"] is None else b"")) for r in got), key=key) == sorted(want, key=key)


def test_members_stand_alone(spark, pages, tmp_path):
    mixed, single = str(tmp_path / "mixed"), str(tmp_path / "single")
    index = warc.normalise(spark, warc.write_monolithic(pages.coalesce(1), mixed), single)
    rows = index.orderBy("offset").collect()
    assert len(rows) == len(ROWS) and len({r["archive"] for r in rows}) == 1
    data = (tmp_path / "single" / rows[0]["archive"]).read_bytes()
    whole = b"".join(gzip.open(f).read() for f in (tmp_path / "mixed").glob("*.gz"))
    assert b"".join(gzip.decompress(data[r["offset"] : r["offset"] + r["length"]]) for r in rows) == whole
    assert warc.archived(pages.limit(0)).collect() == []


def test_damage_is_seen():
    body = b"WARC/1.1\r\nContent-Length: 9\r\n\r\nabc"
    with pytest.raises(ValueError):
        list(warc.split_records(iter([body])))
    buffer = io.BytesIO()
    with gzip.GzipFile(fileobj=buffer, mode="wb") as f:
        f.write(b"x" * 5_000_000)
    data = buffer.getvalue() + zlib.compress(b"", wbits=31) + gzip.compress(b"tail")
    assert b"".join(warc.inflated(data)) == b"x" * 5_000_000 + b"tail"
    with pytest.raises(ValueError):
        list(warc.inflated(data[:100]))


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""), ("", ""), ("plain &amp; simple", "plain & simple"), ("<p>a<p>b<br>c  \n d</p>", "a\n\nb c d"),
        ("<nav>menu</nav><article><h1>T</h1><p>x <b>y</b>z</p><!-- no --><div class='ad box'>buy</div></article><footer>f</footer>", "T\n\nx yz"),
        ("<main><article>in</article></main><aside>no</aside>", "in"),
        ("<header>no</header><article><header><h1>Title</h1></header><p>x</p><footer>by</footer><section id=comments>me</section></article>", "Title\n\nx"),
        ("<body><script>var t='<p>no</p>';</script><style>p{}</style><form>f</form><div role=navigation>n</div><p>yes &eacute;</p>", "yes é"),
        ("<article>cut <p>off <b", "cut\n\noff"), ("<article>a</div>b</article><article>c</article>", "ab\n\nc"), ("a < b & c", "a < b & c"),
    ],
)
def test_pages(page, text):
    assert h.extract(page) == text


def site(i, text):
    return f"<html><body><div class=top>Our site</div><ul><li>Home</li><li>News</li></ul><div class=c><h2>{text[:9]}</h2><p>{text}</p><p>More {i}: {text[::-1]}</p></div><div class=z>Rights</div></body></html>"


def test_wrapper_finds_the_content():
    pages = [site(i, f"story {i} of many words " * (i + 1)) for i in range(5)]
    w = h.infer(pages)
    assert w["root"] == ["html", "body", "div.c"] and "Our site" in w["template"] and "(<p # </p)+" in w["expression"]
    assert h.extract(pages[1], w).split("\n\n")[0] == "story 1 o" and "Rights" not in h.extract(pages[1], w)
    assert h.infer([])["root"] == [] and h.extract(pages[0], h.infer([])).startswith("Our site")


def test_hosts(spark, monkeypatch):
    rows = [(i, f"http://H.example:80/{i}", site(i, f"story {i} of words " * (i + 2))) for i in range(30)]
    rows += [(99, None, None), (None, "http://x/", "<p>x</p>"), (5, rows[5][1], rows[5][2])]
    df = spark.createDataFrame([(*r, "c") for r in rows], "page_id bigint, url string, html string, host string")
    got = sorted(((r["page_id"], r["text"], r["n_chars"]) for r in h.main_text(df).collect()), key=str)
    assert len(got) == 33 and all("Our site" not in t and len(t) == n for _, t, n in got)
    monkeypatch.setattr(h, "SENT_BYTES", -1)
    assert sorted(((r["page_id"], r["text"], r["n_chars"]) for r in h.main_text(df).collect()), key=str) == got
    assert h.main_text(df.limit(0)).collect() == []


def test_wrapper_decides_beside_articles():
    assert h.extract('<main><p>long text</p><article class="teaser">x</article></main>') == "long text\n\nx"
    teaser = '<article class="teaser">Buy our book</article>'
    pages = [site(i, f"story {i} of many words " * (i + 1)).replace("<div class=z>", teaser + "<div class=z>") for i in range(5)]
    w = h.infer(pages)
    assert w["root"] == ["html", "body", "div.c"]
    text = h.extract(pages[2], w)
    assert text.startswith("story 2 o\n\nstory 2 of many") and "Buy our book" not in text and "Rights" not in text
    # A page of another layout keeps what its own tags hold.
    assert h.extract("<html><body><article><p>x</p></article></body></html>", w) == "x"
    posts = [f"<html><body><article id=post-{i}><h1>Name {i}</h1><p>Text of {i}</p></article><div>by {i}</div></body></html>" for i in range(4)]
    w = h.infer(posts)
    assert w["root"] == ["html", "body", "article"] and h.extract(posts[3], w) == "Name 3\n\nText of 3"


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ('<body class="no-sidebar"><p>x</p></body>', "x"), ('<body class="sidebar"><p>x</p></body>', "x"),
        ('<article class="post category-social"><p>x</p></article>', "x"), ('<main id=related><p>x</p></main>', "x"),
        ('<body><div id=content class="content sidebar-right"><p>x</p></div><p>y</p></body>', "x\n\ny"),
        ('<body><div class="banner"><p>all of the text</p></div><div class="share">send</div><p>y</p></body>', "all of the text\n\ny"),
        ('<article><p>some text</p><div class="Ad box">buy</div><div class="ad-free">kept</div></article>', "some text\n\nkept"),
    ],
)
def test_class_names_hide_no_content(page, text):
    assert h.extract(page) == text


def flat(i, more=""):
    own = f"<h2>Name {i}</h2><p>One {i}</p><ul><li>Point {i}</li></ul><p>Two {i}</p><blockquote>Said {i}</blockquote><p>{f'Long {i} ' * 40}</p>"
    return f"<html><body><div class=top>Our site</div><div class=c><div class=a>{own}</div><div class=b><p>Second part {i}</p></div></div>{more}</body></html>"


def test_wrapper_keeps_all_blocks():
    w = h.infer([flat(i) for i in range(5)])
    assert w["root"] == ["html", "body", "div.c"]
    assert h.extract(flat(3), w).split("\n\n") == ["Name 3", "One 3", "Point 3", "Two 3", "Said 3", ("Long 3 " * 40).strip(), "Second part 3"]


def test_wrapper_of_near_copies():
    shared = "".join(f"<h{k}>Part {k}</h{k}><p>{' '.join(f'w{k}x{j}' for j in range(40))}</p>" for k in range(2, 6))
    copies = [f"<html><body><div class=c><h1>Shared</h1>{shared}<div class=d><p>Read {i} times</p></div></div></body></html>" for i in range(6)]
    w = h.infer(copies)
    assert w["template"] == [] and h.extract(copies[1], w) == h.extract(copies[1])


def test_whole_streams_are_aligned():
    menu = "".join(f"<div class=m{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}><p>Menu {i}</p></div>" for i in range(1500))
    pages = [f"<html><body>{menu}<div class=c><h2>Name {i}</h2><p>{f'Text {i} ' * 9000}</p></div></body></html>" for i in range(3)]
    w = h.infer(pages)
    assert w["root"] == ["html", "body", "div.c"] and h.extract(pages[2], w).startswith("Name 2\n\nText 2")


def test_common_subsequences():
    rng = random.Random(4)
    for _ in range(200):
        a, b = ([rng.choice("abcd") for _ in range(rng.randint(0, 30))] for _ in range(2))
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a)):
            for k in range(len(b)):
                best[i + 1][k + 1] = best[i][k] + 1 if a[i] == b[k] else max(best[i][k + 1], best[i + 1][k])
        found = h.common(a, b)
        assert len(found) == best[-1][-1] and all(a[i] == b[k] for i, k in found)
        assert all(x < u and y < v for (x, y), (u, v) in zip(found, found[1:]))


def news(i, body="", after="", before=""):
    article = f"<h1>Title {i}</h1>" + "".join(f"<p>Paragraph {k} of story {i} has its own words {i * 7 + k}.</p>" for k in range(3))
    return f"<html><body><div class=top>The Site</div>{before}<article>{article}{body}</article>{after}<div class=z>Rights</div></body></html>"


def news_text(i, *more):
    return "\n\n".join([f"Title {i}", *(f"Paragraph {k} of story {i} has its own words {i * 7 + k}." for k in range(3)), *more])


def test_reader_comments_are_no_article():
    for label in ("comments", "comment-list", "user-comments"):
        pages = [news(i, after=f"<div class={label}>" + "".join(f"<div><b>Reader {k}{i}</b><p>{f'I think {i} ' * 40}</p></div>" for k in range(5)) + "</div>") for i in range(6)]
        w = h.infer(pages)
        assert w["tagged"] and [h.extract(p, w) for p in pages] == [news_text(i) for i in range(6)], label
    own = "<article class=comment><p>Reader</p></article>"
    assert h.extract(news(1, after=own * 9)) == news_text(1)


def untagged(i, latest):
    links = "".join(f"<li><a href=/{k}>Story {k} of {i}</a></li>" for k in range(4))
    latest = {"list": f"<div class=l><h3>Latest</h3><ul>{links}</ul></div>", "inside": ""}[latest]
    menu = "<div class=m><ul><li><a href=/>Home</a></li><li><a href=/n>News</a></li></ul></div><div class=n><p>We moved offices</p></div>"
    body = f"<div class=c><h1>Title {i}</h1><p>{f'Words of {i} ' * 20}</p><div class=d><p>Tail {i}</p></div></div>"
    return f"<html><body>{menu}{body}{latest}<div class=z>Rights</div></body></html>"


@pytest.mark.parametrize("latest", ["list", "inside"])
def test_varying_links_do_not_widen_the_content(latest):
    pages = [untagged(i, latest) for i in range(6)]
    w = h.infer(pages)
    assert w["root"] == ["html", "body", "div.c"]
    assert h.extract(pages[3], w) == f"Title 3\n\n{('Words of 3 ' * 20).strip()}\n\nTail 3"


def test_menus_in_the_content_are_left_out():
    pages = [untagged(i, "inside").replace("<div class=z>", f"<p>Seen {i * 31} times</p><div class=z>") for i in range(6)]
    w = h.infer(pages)
    assert w["root"] == ["html", "body"]
    assert h.extract(pages[2], w) == f"Title 2\n\n{('Words of 2 ' * 20).strip()}\n\nTail 2\n\nSeen 62 times"
    # A heading that all articles share stays, alone in a container too, and so does a list of words.
    pages = [news(i, body=f"<div><h2>Tools</h2></div><ul><li>Saw</li><li>File</li></ul><p>End {i}</p>") for i in range(6)]
    assert h.extract(pages[4], h.infer(pages)) == news_text(4, "Tools", "Saw", "File", "End 4")


@pytest.mark.parametrize("label", ["side-bar", "cookie-notice", "ad-slot", "site-footer", "comment-list", "user_comments"])
def test_parts_of_class_names(label):
    assert h.extract(f"<body><div class='x {label}'>other</div><p>some running text</p></body>") == "some running text"


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<p>a <span hidden>b <span>c</span></span>d</p>", "a d"), ("<p>a <span class='ad'>b</span>d</p><p>e", "a d\n\ne"),
        ("<p>a <span hidden>b</p><p>c</p>", "a\n\nc"), ("<article><p class=related>x</p><p>y</p></article>", "x\n\ny"),
        ("<pre>a <span class=comment>b</span></pre>", "a b"), ("<p>a <a class=related href=x>b</a></p>", "a b"),
        ("<body><div class=has-sidebar><p>x</p></div><p>y z</p></body>", "x\n\ny z"),
        ("<body><div class='layout sidebar-page'><article><p>x</p></article><p>y</p></div><p>long other text</p></body>", "x"),
        ("<body><div class=comments><p>only this</p></div></body>", "only this"),
    ],
)
def test_attributes(page, text):
    assert h.extract(page) == text


@pytest.mark.parametrize("seed", range(8))
def test_made_sites(seed):
    """Pages put together from known articles and known other parts: the articles come out, and nothing else."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    menu = f"<div class={word()}><ul>" + "".join(f"<li><a href=/{k}>{word()}</a></li>" for k in range(rng.randint(2, 6))) + "</ul></div>"
    notice, footer = f"<div class={word()}><p>{text(12)}</p></div>", f"<footer>{text(6)}</footer>"
    tag, box = rng.choice(["article", "main", "div class=story", "section class=s"]), rng.choice(["", "comments", "reader-comments", "related-posts", "ad-box"])
    pages, want = [], []
    for _ in range(6):
        blocks = [("h1", text(4))] + [(rng.choice(["p", "p", "p", "blockquote", "h2"]), text(rng.randint(5, 60))) for _ in range(rng.randint(3, 9))]
        body = "".join(f"<{name}>{t}</{name}>" for name, t in blocks)
        latest = "<div class=latest><ul>" + "".join(f"<li><a href=/x>{text(5)}</a></li>" for _ in range(rng.randint(2, 5))) + "</ul></div>"
        extra = f"<div class='{box}'><p>{text(rng.randint(5, 30))}</p></div>" if box else ""
        pages.append(f"<html><body><div class=top>{menu}{notice}</div><{tag}>{body}</{tag.split()[0]}>{extra}{latest}{footer}</body></html>")
        want.append("\n\n".join(t for _, t in blocks))
    w = h.infer(pages)
    assert [h.extract(p, w) for p in pages] == want


def test_all_pages_of_a_host_vote(spark):
    """Forty pages, the copies of one and five of another layout: each different page takes part, and most of them decide."""
    menu = "<div class=m><p>Opening hours and prices</p><p>We moved offices</p></div>"
    rng = random.Random(5)
    odd = [f"<html><body><div class=o><p>{' '.join(str(rng.random()) for _ in range(30))}</p></div></body></html>" for _ in range(5)]
    usual = [
        f"<html><body>{menu}<div class=c><h1>Title {i}</h1><p>{' '.join(str(rng.random()) for _ in range(60))}</p></div></body></html>" for i in range(40)
    ]
    rows = [(i, "http://a/x", p) for i, p in enumerate(usual + odd + usual[:1] * 30)] + [(99, "http://b/", "<p>one</p>"), (98, "http://c/", None)]
    df = spark.createDataFrame(rows, "page_id int, url string, html string")
    hosts = {r.host: json.loads(r.wrapper) for r in h.wrappers(df.select(h.host_of(df.url).alias("host"), "html")).collect()}
    assert set(hosts) == {"a", "b"} and hosts["a"]["pages"] > 20
    lone = h.infer(["<p>one</p>"])
    assert hosts["b"] == {k: lone[k] for k in ("root", "template", "tagged", "pages")}
    assert len({r.text for r in h.main_text(df).where("page_id < 40").collect()}) == 40
    for i, text in h.main_text(df).where("page_id < 40").select("page_id", "text").collect():
        assert text == f"Title {i}\n\n" + usual[i].split("<p>")[-1].split("<")[0]


def plain_unlike(streams):
    kept = []
    for items in streams:
        words = [w for _, t in items for w in t.split()]
        runs = Counter(tuple(words[i : i + h.RUN]) for i in range(max(1, len(words) - h.RUN + 1)))
        if all((runs & other).total() < h.NEAR * (runs | other).total() for _, other in kept):
            kept.append((items, runs))
    return [items for items, _ in kept]


def test_near_copies_cost_no_call_a_word():
    """Near copies are those of the plain definition, and pages without common runs are told apart cheaply."""
    rng = random.Random(7)
    for _ in range(60):
        base = [rng.choice("abc") for _ in range(rng.randint(0, 40))]
        streams = [[("#", " ".join(rng.choice("abc") if rng.random() < 0.03 else w for w in base))] for _ in range(6)] + [[("#", "")], []]
        assert h.unlike(streams) == plain_unlike(streams)
    streams = [[("#", " ".join(f"w{i}x{k}" for k in range(2000)))] for i in range(6)]
    calls = 0

    def count(frame, event, arg):
        nonlocal calls
        calls += event == "call"

    sys.setprofile(count)
    try:
        kept = h.unlike(streams)
    finally:
        sys.setprofile(None)
    assert kept == streams and calls < 2000


def test_pages_of_a_host_are_dealt_to_tasks(spark):
    """The shuffle of the pages goes by host and group."""
    df = spark.createDataFrame([("a", f"<p>{i}</p>") for i in range(600)], "host string, html string")
    seen = []

    def spy(rows, f, schema):
        seen.append(rows)
        return by_batch(rows, f, schema)

    by_batch, h.by_batch = h.by_batch, spy
    adaptive = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    least = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert h.wrappers(df).count() == 1
        tasks = seen[0].select(F.spark_partition_id().alias("p")).distinct().count()
    finally:
        h.by_batch = by_batch
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", adaptive)
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", least)
    assert tasks > 1


def test_every_page_counts(spark):
    rng = random.Random(6)
    pages = [f"<html><body><div class=m><p>We moved</p></div><div class=c><p>{' '.join(str(rng.random()) for _ in range(40))}</p></div></body></html>" for _ in range(50)]
    df = spark.createDataFrame([("a", p) for p in pages * 2], "host string, html string")
    (row,) = h.wrappers(df, group=50).collect()
    assert json.loads(row.wrapper) == {"root": ["html", "body", "div.c"], "template": ["We moved"], "tagged": False, "pages": 50}
