import hashlib
import html
import re
import time
import struct

import duckdb
import pytest
from pyspark.sql import functions as F

from entroflow.llm import html_text, warc

SCHEMA = "page_id long, url string, html string, file string"
BIG = "<p>" + "same payload " * 200 + "</p>"


def brute(rows):
    top = {}
    for i, h in rows:
        if len((h or "").encode()) >= 1000 and i is not None:
            top[h] = max(top.get(h, i), i)
    out = []
    for i, h in rows:
        raw = (h or "").encode()
        to = top.get(h) if len(raw) >= 1000 and i is not None else None
        to = None if to == i else to
        out.append((i, len(raw), hashlib.sha1(raw).hexdigest(), "response" if to is None else "revisit", to))
    return sorted(out, key=str)


def got(df):
    return sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in df.collect()), key=str)


def test_archives(spark):
    rows = [(1, None), (2, ""), (3, "short"), (4, "short"), (5, BIG), (9, BIG), (7, BIG), (8, "é" * 500), (10, "é" * 500), (11, "x" * 300_000), (None, BIG), (12, "a\r\n\r\nb\0")]
    rows += [(100 + i, f"<html><body><p>page {i} of many</p></body></html>") for i in range(100)]
    df = spark.createDataFrame([(i, f"http://e/{i}\n" if i != 3 else None, h, "clash") for i, h in rows], SCHEMA)
    result = warc.archive_pages(df)
    assert got(result) == brute(rows)
    payload = {r.page_id: r.payload for r in result.collect() if r.record_type == "response" and r.page_id}
    assert all(bytes(payload[i]).decode() == (h or "") for i, h in rows if i in payload)
    assert got(warc.archive_pages(df.where("false"))) == []


def test_more_shared_payloads_than_are_broadcast(spark):
    rows = [(i, f"payload {i % 9} " * 200) for i in range(40)] + [(100, "short"), (101, None), (None, "payload 1 " * 200), (39, "payload 2 " * 200)]
    df = spark.createDataFrame([(i, "http://e", h, "clash") for i, h in rows], SCHEMA)
    by_key = warc.with_references(df, most_shared=0).select("page_id", "refers_to").collect()
    assert sorted(by_key, key=str) == sorted(warc.with_references(df).select("page_id", "refers_to").collect(), key=str)
    assert got(warc.archive_pages(df)) == brute(rows)


def test_file_layout(spark, tmp_path):
    df = spark.createDataFrame([(i, "http://e", f"<p>page {i} with some common text around it</p>", "") for i in range(300)], SCHEMA)
    files = warc.write_archives(warc.with_references(df.coalesce(1)), f"file://{tmp_path}/w").collect()
    assert sum(f.records for f in files) == 300
    raw = open(files[0].file, "rb").read()
    magic, size = struct.unpack("<II", raw[:8])
    assert magic == 0x184D2A5D and raw[8 + size :][:4] == b"\x28\xb5\x2f\xfd"
    assert raw[8:][:4] == b"\x28\xb5\x2f\xfd" and not list(tmp_path.glob("w/*.part"))


def test_damage_is_noticed():
    r = warc.record(1, "u", b"payload", None)
    assert warc.parse(r)[1] == b"payload"
    for bad in (r.replace(b"payload", b"paxload"), r[:-3]):
        with pytest.raises(ValueError):
            warc.parse(bad)


def test_warc_sql(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{sf_dir}/pages.parquet')")
    want = con.execute(f"SELECT page_id, payload_bytes, payload_digest, record_type, refers_to FROM ({warc.OP6_SQL})").fetchall()
    assert got(warc.op6_warc(spark, sf_dir)) == sorted(want, key=str)


PAGES = [
    (None, ""),
    ("", ""),
    ("plain &amp; simple\n text", "plain & simple text"),
    ("<p>one<p>two<br>lines</p>", "one\n\ntwo lines"),
    ("<script>var a='<p>no</p>'</script><p>a &lt;b&gt; &eacute;</p><!-- <p>no</p> -->", "a <b> é"),
    ("<body><nav><ul><li><a href='/'>Home</a></li></ul></nav><article><h1>Title here</h1><p>Body text of it.</p></article><footer>&copy; all rights kept here</footer></body>", "Title here\n\nBody text of it."),
    ("<div class='ad'>Buy this thing today, it is so very good for you</div><div><h1>Real title</h1><p>" + "word " * 30 + "</p></div><section id='comments'><p>" + "nice one " * 30 + "</p></section>", "Real title\n\n" + ("word " * 30).strip()),
    ("<article><p>" + "first " * 20 + "</p><aside class='sidebar'><p>" + "other " * 5 + "</p></aside><p>" + "last " * 20 + "</p></article>", ("first " * 20).strip() + "\n\n" + ("last " * 20).strip()),
    ("<form><label>Name</label><input><button>Send now</button></form>", ""),
    ("<p title='a > b'>kept</p", "kept"),
    ("<article><p>see <a href='x'>this link</a> and <b>that</b>.</p></article>", "see this link and that."),
]


@pytest.mark.parametrize("page,text", PAGES)
def test_main_text(page, text):
    assert html_text.main_text(page) == text


@pytest.mark.parametrize("seed", [3, 77])
def test_labelled_pages(seed):
    """Pages that the weights are counted on, and others made by the same rules."""
    right = 0
    pages = html_text.labelled_pages(150, seed)
    for parts in pages:
        want = html_text.main_text("<article>" + "".join(p for p, good in parts if good) + "</article>")
        right += html_text.main_text("".join(p for p, _ in parts)) == want != ""
    assert right >= 0.9 * len(pages)


FIRST, LAST = ("first " * 40).strip(), ("last " * 40).strip()
LAYOUTS = [
    ("<article><p>{}</p><div class='ad'>" + "buy now " * 30 + "</div><p>{}</p></article>", "\n\n"),
    ("<div class='post'><p>{}</p><p class='side-effects'>{}</p></div><footer>rights</footer>", "\n\n"),
    ("<div class='post'><p>{}</p><div id='related-work'><p>{}</p></div></div><footer>rights</footer>", "\n\n"),
    ("<body><div class='page-header-wrapper'><nav><a href='/'>Home</a></nav><article><p>{}</p><p>{}</p></article></div></body>", "\n\n"),
    ("<body class='has-sidebar'><div class='layout-sidebar'><div class='main-content'><p>{}</p><p>{}</p></div><div class='sidebar'><p>" + "other " * 30 + "</p></div></div></body>", "\n\n"),
    ("<div id='content'><p>{}</p><ul><li>{}</li></ul></div><div class='comment-list'><p>" + "nice " * 200 + "</p></div>", "\n\n"),
    ("<div class='siteHeader'><a href='/'>x</a> words of it</div><section class='story'><p>{}<br>{}</p></section><div class='cookieNotice'>we use cookies here</div>", " "),
]


@pytest.mark.parametrize("layout,between", LAYOUTS)
def test_layouts(layout, between):
    assert html_text.main_text(layout.format(FIRST, LAST)) == FIRST + between + LAST


@pytest.mark.parametrize("page", ["<span>{}</b>", "<p><body><span>{}<div></div>", "<svg/>{}", "<a {}", "<!{}", "<b{}<i", "<script/>{}</script>", "<p><i>{}</p>", "<li>{}<ul>", "<a '{}<a \"", "<a '>{}<a \"'>"])
def test_odd_markup_in_linear_time(page):
    first, second = page.split("{}")
    took = []
    for n in (20_000, 80_000):
        began = time.perf_counter()
        html_text.parse(first * n + second * n)
        took.append(time.perf_counter() - began)
    assert took[1] < 10 * took[0] + 0.5


OPEN_ENDS = [("a <!-- b > c", "a"), ("a <!-->", "a"), ("x > y <b", "x > y"), ("<p>a</p>b <a <i", "a\n\nb <a"), ("a<![CDATA[ b > c", "a"), ("<p>a <b>c</p>d", "a c\n\nd"), ("1 < 2 > 1", "1 < 2 > 1"), ("<b>a > b", "a > b")]


@pytest.mark.parametrize("page,text", OPEN_ENDS)
def test_open_ends(page, text):
    assert html_text.main_text(page) == text


def test_weights_have_their_signs():
    w = html_text.weights()
    assert w["word"] >= 1 and all(v < 0 for k, v in w.items() if not k.endswith("word"))


def blocks_of_article(page):
    """The text of <article> by plain replacement: the tables' pages hold no boilerplate in it."""
    article = re.sub(r"<!--.*?-->", "", page.split("<article>")[1].split("</article>")[0], flags=re.S)
    article = re.sub(r"</?(?:p|h1|h2|h3|ul|ol|li|div|blockquote)\b[^>]*>", "\0", re.sub(r"<br\b[^>]*>", " ", article))
    texts = (" ".join(html.unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in article.split("\0"))
    return "\n\n".join(t for t in texts if t)


def test_pages_of_the_table(spark, sf_dir):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    for r in html_text.op3_html_text(spark, sf_dir).collect():
        assert r.text == blocks_of_article(pages[r.page_id]) != "" and r.n_chars == len(r.text)
    rows = [(1, "u", None, "t"), (None, None, "x", "t"), (1, "u", None, "t"), (2, "u", "<p>" + "long " * 200_000, "t")]
    df = spark.createDataFrame(rows, SCHEMA.replace("file string", "text string")).withColumn("n_chars", F.lit("clash"))
    assert sorted(r.n_chars for r in html_text.extract_text(df).collect()) == [0, 0, 1, 999_999]
    assert html_text.extract_text(df.where("false")).count() == 0


@pytest.mark.parametrize("box", ["<aside>{}</aside>", "<div class='newsletter'><h3>{}</h3><form><input></form></div>", "<ul class='related'><li><a href='/'>{}</a></li></ul>"])
@pytest.mark.parametrize("n", [60, 6000])
def test_boilerplate_inside_an_article_costs_no_side(box, n):
    title, lead, body = "A title of six plain words", ("lead " * 40).strip(), ("body " * 50).strip()
    page = f"<body><nav><a href='/'>Home</a></nav><article><h1>{title}</h1><p>{lead}</p>{box.format('buy this ' * n)}<p>{body}</p></article><footer>all rights kept</footer></body>"
    assert html_text.main_text(page) == f"{title}\n\n{lead}\n\n{body}"
