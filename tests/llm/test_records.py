"""Operators on pages, conversations, archives and tokens, and the pipeline."""

from __future__ import annotations

import hashlib
import os
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from varve.llm import chat, html_text, packing, token_files, tokenizing, warc

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


# --- Pages

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head><body class="has-sidebar"><header>Site</header>
<nav><ul><li><a href="/x">Menu</a></ul></nav><div class="ad-box top">Buy</div><!-- <p>hidden</p> --><article><h1>A &amp; B</h1><p>One  two<br>three
<p><b>Bold</b> text &#233;<div class="share">Share</div><ul><li>item 1<li>item 2</ul><form><p>Name</p></form><section id="comments"><p>First!</p></section></article>
<aside>Side</aside><footer>&copy; x</footer></body></html>"""


def test_article_without_what_surrounds_it(spark):
    want = "A & B\n\nOne two three\n\nBold text é\n\nitem 1\n\nitem 2"
    pages = spark.createDataFrame([(1, "http://h/a", PAGE), (2, None, None), (None, "http://h/b", ""), (3, "x", "<p>cut <b>off"), (1, "http://h/a", PAGE)], "page_id long, url string, html string")
    got = html_text.extract(pages.withColumn("host", F.lit("clash")).withColumn("blocks", F.lit(1))).collect()
    assert sorted((r.page_id or 0, r.text, r.n_chars) for r in got) == sorted([(1, want, len(want)), (1, want, len(want)), (2, "", 0), (0, "", 0), (3, "cut off", 7)])
    assert html_text.extract(pages.limit(0)).count() == 0


def test_constant_nodes_become_template(spark):
    page = lambda k: f"<html><body><div>Welcome to us</div><div><h1>Title {k}</h1><p>Text {k * 7}</p><p>Same everywhere</p></div><div>All rights</div></body></html>"
    pages = spark.createDataFrame([(k, f"https://www.h.example/{k}", page(k)) for k in range(8)] + [(9, "https://alone/", page(9))], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html_text.extract(pages).collect()}
    assert all(got[k] == f"Title {k}\n\nText {k * 7}" for k in range(8)) and got[9].startswith("Welcome to us\n\nTitle 9")


def test_copies_of_a_page_are_no_template(spark):
    page = lambda k: f"<html><body><div>Welcome to us</div><article><h1>Title {k}</h1><p>Text {k * 7}</p></article></body></html>"
    plain = lambda k: f"<div>Welcome to us</div><div><h1>Title {k}</h1><p>Text {k * 7}</p></div>"
    rows = [(k, f"http://copies/{k}", page(max(k, 40))) for k in range(43)] + [(100 + k, "http://alone/", page(0)) for k in range(9)]
    rows += [(200 + k, f"http://mixed/{k}", plain(max(k, 40))) for k in range(48)]
    got = {r.page_id: r.text for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[k] == f"Title {max(k, 40)}\n\nText {max(k, 40) * 7}" for k in range(43)) and all(got[100 + k] == "Title 0\n\nText 0" for k in range(9))
    assert all(got[200 + k] == f"Title {max(k, 40)}\n\nText {max(k, 40) * 7}" for k in range(48))  # 8 different pages, so the welcome is template


def test_every_layout_of_a_host_has_its_template(spark):
    post = lambda k: f"<body><div>Welcome to us</div><div><h1>Title {k}</h1><p>Text {k * 7}</p></div></body>"
    table = lambda k: f"<body><table><tr><td>All our lists<tr><td>Entry {k}</table><section><ul><li>Call now<li>More {k}</ul></section></body>"
    odd = lambda k: f"<body><dl><dt>Error {k}<dd>Not found</dl></body>"
    rows = [(k, f"http://h/{k}", post(k)) for k in range(12)] + [(100 + k, f"http://h/t{k}", table(k)) for k in range(12)] + [(200 + k, f"http://h/o{k}", odd(k)) for k in range(2)]
    got = {r.page_id: r.text for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[k] == f"Title {k}\n\nText {k * 7}" and got[100 + k] == f"Entry {k}\n\nMore {k}" for k in range(12))
    assert all(got[200 + k] == f"Error {k}\n\nNot found" for k in range(2))


def test_layouts_are_grouped_by_paths():
    own = [("/div /h1 /p", 9, 1), ("/table/td", 6, 2), ("/h1 /p", 3, 3), ("/dl/dt /p", 2, 4)]
    assert html_text.group_layouts(own, 5) == [("/div /h1 /p", 1, True, 12), ("/h1 /p", 1, True, 12), ("/table/td", 2, True, 6), ("/dl/dt /p", 1, False, 12)]
    assert html_text.group_layouts([("/a", 3, 1), ("/b", 2, 2)], 5) == [("/a", 1, True, 5), ("/b", 1, True, 5)] and html_text.group_layouts([("/a", 4, 1)], 5) == []


@pytest.mark.parametrize(
    ("source", "want"),
    [
        ('<p>See <a class="share">x</a> and the rest.</p><p>More', ["See and the rest.", "More"]),
        ('<p>A<span class="ad">x <span>y</span> z <a class="share">w</a> v</span> b</p>tail', ["A b", "tail"]),
        ('<p>A <sup class="comment">1</sup>b<br class="ad">c</p>', ["A b c"]),
        ('<ul><li>A <a class="share">x<li>b</ul><p>c <span class="ad">x<p>d</p>e', ["A", "b", "c", "d", "e"]),
        ('<div>A <b>b</b> <em class="promo">x</em>c</b> d</div>', ["A b c d"]),
    ],
)
def test_marked_inline_elements_end(source, want):
    assert [text for _, text in html_text.blocks(html_text.parse(source))] == want


def test_tree_matching_counts_nodes():
    a, b = (html_text.parse(x) for x in ("<div><p>1<p>2<ul><li>a<li>b</ul></div>", "<div><p>1<ul><li>a</ul><p>3</div>"))
    assert len(html_text.match(a, b)) == 5  # root, div, p, ul, li


def brute_weight(a, b):
    """Simple tree matching as it is defined, by recursion over all pairs."""
    if a.tag != b.tag:
        return 0
    table = [[0] * (len(b.children) + 1) for _ in range(len(a.children) + 1)]
    for i, x in enumerate(a.children):
        for j, y in enumerate(b.children):
            table[i + 1][j + 1] = max(table[i][j] + brute_weight(x, y), table[i][j + 1], table[i + 1][j])
    return 1 + table[-1][-1]


def test_matching_is_as_large_as_brute_force(monkeypatch):
    rng = random.Random(3)

    def grow(depth):
        node = html_text.Node(rng.choice("ab" if depth else "r"), None)
        node.children = [grow(depth + 1) for _ in range(rng.randint(0, 4 if depth < 4 else 0))]
        for c in node.children:
            c.parent = node
        return node

    for _ in range(300):
        a, b = grow(0), grow(0)
        pairs = html_text.match(a, b)
        assert len(pairs) == brute_weight(a, b)
        monkeypatch.setattr(html_text, "SMALL", 0)
        assert html_text.match(a, b) == pairs
        monkeypatch.undo()
        of = {id(x): y for x, y in pairs}
        assert len({id(y) for _, y in pairs}) == len(of) == len(pairs)
        for x, y in pairs:  # one to one, of equal tags, in order, and below pairs only
            assert x.tag == y.tag and (x.parent is None or of[id(x.parent)] is y.parent)
            places = [y.children.index(of[id(c)]) for c in x.children if id(c) in of]
            assert places == sorted(places)


def test_deep_and_long_pages(spark):
    deep = lambda k: "<html><body><div>Welcome</div>" + "<div>" * 10_000 + f"<p>Deep text {k}</p>"
    items = lambda k: "<html><body><ul>" + "".join(f"<li>{'<p>' if (i * k) % 3 else ''}item {i * k}</li>" for i in range(5000)) + "</ul>"
    rows = [(k, f"http://deep/{k}", deep(k)) for k in range(6)] + [(10 + k, f"http://long/{k}", items(k + 1)) for k in range(6)]
    got = {r.page_id: r.text for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[k] == f"Deep text {k}" for k in range(6))
    for k in range(6):  # item 0 is the same everywhere
        assert got[10 + k] == "\n\n".join(f"item {i * (k + 1)}" for i in range(1, 5000))


def test_pages_without_a_host_have_no_wrapper(spark):
    page = lambda k: f"<body><div>Same words</div><p>Text {k}</p></body>"
    rows = [(k, (None, "", "not a url")[k % 3], page(k)) for k in range(30)]
    got = html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert sorted((r.page_id, r.text) for r in got) == [(k, f"Same words\n\nText {k}") for k in range(30)]


def test_unmarked_pages_give_the_text_of_marked_ones(spark):
    rng = random.Random(8)
    words = lambda n: " ".join("".join(rng.choices("abcdefgh", k=rng.randint(2, 8))) for _ in range(n))

    def page():
        menu = "".join(f'<li><a href="/x">{words(1)}</a></li>' for _ in range(rng.randint(3, 7)))  # its words differ from page to page
        advert = f'<div class="ad">{words(6)}</div>' if rng.random() < 0.7 else ""
        article = f"<h1>{words(5)}</h1>" + "".join(f"<p>{words(rng.randint(5, 60))}" + (f' <a href="/y">{words(2)}</a>' if rng.random() < 0.3 else "") + "</p>" for _ in range(rng.randint(6, 20)))
        comments = "".join(f'<p>{words(4)}</p>' for _ in range(rng.randint(0, 3)))
        return f'<html><body><header>Our site</header><nav><ul>{menu}</ul></nav>{advert}<article>{article}</article><div class="comments">{comments}</div><footer>All rights reserved</footer></body></html>'

    marked = [page() for _ in range(20)]
    plain = [re.sub(r' class="[a-z]+"', "", re.sub(r"<(/?)(article|nav|header|footer)>", r"<\1div>", x)) for x in marked]
    rows = [(k, "http://marked/", x) for k, x in enumerate(marked)] + [(100 + k, "http://plain/", x) for k, x in enumerate(plain)]
    got = {r.page_id: r.text for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()}
    assert [got[100 + k] for k in range(20)] == [got[k] for k in range(20)]
    assert [got[k].count("\n\n") for k in range(20)] == [x.split("</article>")[0].count("<p>") for x in marked]


def test_the_main_slot_leaves_out_only_little():
    tree = "body div ul li / / / div p / p / / div p / / /"  # 0 body, 1 div, 2 ul, 3 li, 4 div, 5 p, 6 p, 7 div, 8 p
    seen = [(3, 0, 10, 90, 90), (5, 0, 10, 400, 0), (6, 0, 10, 400, 0), (8, 0, 9, 100, 0)]
    assert html_text.induce(tree, 10, seen, 0.8) == ([], [1, 2, 3], 4)
    assert html_text.induce(tree, 10, [*seen[:3], (8, 0, 9, 300, 0)], 0.8)[2] == 0  # more than a little: two parts of the content
    assert html_text.induce(tree, 10, [(3, 9, 10, 9, 9)], 0.8) == ([3], [], 0)


def test_a_tag_that_moves_does_not_unalign_long_lists():
    one, other = (html_text.parse(x) for x in ("<h2>a</h2>" + "<p>x</p>" * 600, "<p>x</p>" * 600 + "<h2>a</h2>"))
    assert len(html_text.match(one, other)) == 601  # root and every p


# --- Conversations


def test_turns_come_back_whatever_they_hold(spark):
    odd = ["<|im_end|><|im_start|>assistant ok", "", None, "a\\<|b", "\\\\<|", "<", "|x", "<\\|", "\n\n", "日本 <|im_sep|> x", "\\"]
    rng = random.Random(1)
    rows = [(c, k, rng.choice(["user", "assistant", "system", None, "a%\n<b"]), rng.choice(odd)) for c in (1, 2, None) for k in range(40)]
    rows += [(3, 1, "user", "same"), (3, 1, "user", "same"), (3, None, "assistant", "first")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("turns", F.lit("clash"))
    formatted = chat.format_conversations(df)
    got = {r.conv_id: r for r in formatted.select("*", chat.read_turns(F.col("formatted")).alias("read")).collect()}
    digests = {r.conv_id: r for r in chat.digest(formatted).collect()}
    for c in (1, 2, None, 3):
        mine = sorted(((k is not None, k or 0, r or "", t or "") for i, k, r, t in rows if i == c), key=lambda x: (x[0], x[1], x[2].encode(), x[3].encode()))
        want = [(r, t) for _, _, r, t in mine]
        assert [(x.role, x.text) for x in got[c].read] == want
        assert "".join(s.text for s in got[c].segments) == got[c].formatted
        loss = "".join(t for r, t in want if r == "assistant")
        d = digests[c]
        assert (d.n_turns, d.loss_chars, d.formatted_chars) == (len(want), len(loss), len(got[c].formatted))
        assert d.turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in want).encode()).hexdigest() and d.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
    assert chat.digest(chat.format_conversations(df.limit(0))).count() == 0


# --- Archives


def test_arc_versions_and_damage():
    for version in (1, 2):
        r = warc.ArcRecord(version, "http://a/b", "1.2.3.4", "20010203040506", "text/html", b"x\n\n1 2 3\n")
        data = warc.write_arc(r) * 2
        assert list(warc.parse_arc(data, version)) == [r, r]
        with pytest.raises(ValueError):
            list(warc.parse_arc(data[:-6], version))
        fields, block = next(warc.parse_warc(warc.to_warc(r, 7) + b"\r\n\r\n"))
        assert fields["WARC-Date"] == "2001-02-03T04:05:06Z" and fields["WARC-Type"] == "response" and block == r.payload
    assert b"http://a/b%20c" in warc.write_arc(warc.ArcRecord(1, "http://a/b c", "-", "2001", "t", b""))


def test_archives_round_trip(spark):
    tricky = "WARC/1.1\r\n\r\n\r\n\r\nContent-Length: 3\r\n\r\n é"
    rows = [(1, "http://x/1", tricky), (2, "http://x/2", tricky), (3, None, None), (4, "u", ""), (9, "http://x/ 9\n", "a"), (9, "v", "a"), (5, "w", "a"), (None, "n", tricky)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("sha", F.lit("clash"))
    got = sorted((r.page_id or 0, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.convert_pages(pages).collect())
    d = lambda t: warc.digest((t or "").encode())
    n = len(tricky.encode())
    want = [(0, n, d(tricky), "response", None), (1, n, d(tricky), "revisit", 2), (2, n, d(tricky), "response", None), (3, 0, d(""), "revisit", 4), (4, 0, d(""), "response", None), (5, 1, d("a"), "revisit", 9)]
    assert got == want + [(9, 1, d("a"), "response", None)] * 2
    assert {r.record_type for r in warc.convert_pages(pages, min_bytes=10**6).collect()} == {"response"} and warc.convert_pages(pages.limit(0)).count() == 0


def test_archives_match_brute_force(spark, tmp_path):
    rng = random.Random(5)
    bodies = ["", "x" * 40, *["".join(rng.choices("ab<>\r\n é", k=rng.randint(1, 300))) for _ in range(40)], "big " * 100_000]
    rows = [(rng.choice([None, *range(200)]), f"http://h/{k % 7}", rng.choice([None, *bodies])) for k in range(600)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    path = f"file://{tmp_path}/warc"
    warc.write_archives(pages, path, min_bytes=1, file_bytes=20_000)
    got = sorted((r.page_id if r.page_id is not None else -1, r.payload_digest, r.payload_bytes, r.record_type, r.refers_to or -1) for r in warc.read_archives(spark, path).collect())
    newest = {}
    for i, _, html in rows:
        if i is not None:
            newest[html or ""] = max(i, newest.get(html or "", -1))
    want = []
    for i, _, html in rows:
        payload = html or ""
        again = i is not None and payload and newest[payload] > i
        want.append((-1 if i is None else i, warc.digest(payload.encode()), len(payload.encode()), "revisit" if again else "response", newest[payload] if again else -1))
    assert got == sorted(want)
    sizes = [os.path.getsize(tmp_path / "warc" / f) for f in os.listdir(tmp_path / "warc")]
    assert len(sizes) > 4 and max(sizes) < 30_000 and not [f for f in os.listdir(tmp_path / "warc") if not re.fullmatch(r"part-\d{6}-\d{5}\.warc\.gz", f)]


def test_arc_archives_state_their_version(spark, tmp_path):
    import gzip

    records = {v: [warc.ArcRecord(v, f"http://a/{v}/{k}", "1.2.3.4", "20010203040506", "text/html", b"<p>%d\n" % k) for k in range(30)] for v in (1, 2)}
    (tmp_path / "arcs").mkdir()
    for v, name in ((1, "one.arc"), (2, "two.arc.gz")):
        parts = [warc.write_filedesc(v, "20010203", name), *map(warc.write_arc, records[v])]
        (tmp_path / "arcs" / name).write_bytes(b"".join(map(gzip.compress, parts)) if name.endswith("gz") else b"".join(parts))
        assert warc.arc_version(parts[0]) == v
    warc.convert_arcs(spark, f"file://{tmp_path}/arcs", f"file://{tmp_path}/warc", file_bytes=500)
    got = warc.read_archives(spark, f"file://{tmp_path}/warc").collect()
    assert sorted((r.url, bytes(r.block)) for r in got if r.record_type == "response") == sorted((r.url, r.payload) for v in records for r in records[v])
    assert sorted(r.url for r in got if r.record_type == "warcinfo") == ["filedesc://one.arc", "filedesc://two.arc.gz"]
    for bad in (b"http://a 1 2 3 4\n", b"filedesc://x 0 0 t 5\n9 0 x\n"):
        with pytest.raises(ValueError):
            list(warc.parse_arc(bad))
    with pytest.raises(ValueError, match="cut short"):
        list(warc.members(gzip.compress(b"abc" * 100)[:-9]))


# --- Tokens


def odd_texts(n=1500):
    rng = random.Random(1)
    parts = ["a", "B", "é", " ", "  ", "\n", "\n\n", "\t", "\r\n", ",", ".", "'s", " ", "\0", "日本", "<|endoftext|>", "123", "#$%", "\x1c", " ", "🙂", "İ", " x", " ,", "word", "́"]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(n)] + [None, "", "a" * 3000, "word " * 3000]


def test_encoder_equals_the_library():
    reference = Tokenizer.from_file(TOKENIZER)
    reference.encode_special_tokens = True
    texts = odd_texts()
    want = [np.array(e.ids, "<u4").tobytes() for e in reference.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    encoder = tokenizing.Encoder(TOKENIZER)
    assert encoder.encode(texts) == want and encoder.encode(texts) == want


def encoded(texts):
    return [np.append(np.frombuffer(x, "<u4"), np.uint32(0)).astype("<u4") for x in tokenizing.Encoder.of(TOKENIZER).encode(texts)]


@pytest.mark.parametrize("encoding", ["dictionary", "delta"])
def test_token_files_round_trip(spark, documents, tmp_path, encoding):
    texts = odd_texts(200)
    rng = random.Random(2)
    ids = rng.sample(range(10_000), len(texts) - 2) + [5, 5]
    path = f"file://{tmp_path}/tokens"
    token_files.write_tokens(documents(texts, ids).repartition(3), path, TOKENIZER, encoding=encoding, row_group_bytes=1 << 16)
    read = token_files.read_tokens(spark, path)
    got = sorted(token_files.crc32_of_ids(token_files.with_starts(read)).collect(), key=lambda r: r.start)
    order = sorted(zip(ids, texts, encoded(texts), strict=True), key=lambda x: x[0])
    assert [r.doc_id for r in got] == [i for i, _, _ in order]
    assert [r.start for r in got] == np.concatenate([[0], np.cumsum([r.n_tokens for r in got])])[:-1].tolist()
    assert sorted((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == sorted((i, len(x), zlib.crc32(x.tobytes())) for i, _, x in order)
    some = token_files.read_tokens(spark, path, ["doc_id"], 100, 5000)
    assert {r.doc_id for r in some.collect()} == {i for i in ids if 100 <= i <= 5000}


@pytest.mark.parametrize(("encoding", "name"), [("dictionary", "RLE_DICTIONARY"), ("delta", "DELTA_BINARY_PACKED")])
def test_token_files_are_laid_out_for_selective_reads(spark, documents, tmp_path, encoding, name):
    import pyarrow.parquet as pq

    texts = [" ".join(f"w{(k * 31 + j) % 997}" for j in range(120)) for k in range(1200)]
    path = f"{tmp_path}/tokens"
    token_files.write_tokens(documents(texts).coalesce(1), f"file://{path}", TOKENIZER, encoding=encoding, row_group_bytes=1 << 16, page_bytes=1 << 12)
    files = [f for f in (os.path.join(path, f) for f in os.listdir(path) if f.endswith(".parquet")) if pq.ParquetFile(f).metadata.num_rows]
    groups = [pq.ParquetFile(f).metadata.row_group(g) for f in files for g in range(pq.ParquetFile(f).metadata.num_row_groups)]
    assert len(groups) > len(files)  # more than one row group a file
    for g in groups:
        columns = {g.column(k).path_in_schema: g.column(k) for k in range(g.num_columns)}
        tokens = columns["tokens.list.element"]
        assert name in tokens.encodings and tokens.has_offset_index and columns["doc_id"].has_column_index
        assert g.total_byte_size < 1 << 20
    # Row groups hold ranges of ids that do not overlap, so a filter on ids leaves most of them alone.
    ranges = sorted((g.column(0).statistics.min, g.column(0).statistics.max) for g in groups)
    assert all(a[1] < b[0] for a, b in zip(ranges, ranges[1:], strict=False))
    some = token_files.read_tokens(spark, f"file://{path}", ["doc_id", "n_tokens"], 100, 110)
    plan = some._jdf.queryExecution().toString()
    assert some.count() == 11 and "PushedFilters: [IsNotNull(doc_id), GreaterThanOrEqual(doc_id,100), LessThanOrEqual(doc_id,110)]" in plan
    assert plan.split("ReadSchema: ")[-1].splitlines()[0].strip() == "struct<doc_id:bigint,n_tokens:bigint>"


def test_remembered_pieces_are_forgotten_without_effect(monkeypatch):
    monkeypatch.setattr(tokenizing, "MAX_PIECES", 50)
    reference = Tokenizer.from_file(TOKENIZER)
    encoder = tokenizing.Encoder(TOKENIZER)
    rng = random.Random(4)
    for _ in range(20):
        texts = [" ".join(rng.choice(["the", "of,", "or.", f"w{rng.random()}", "a" * 50, "x" + "".join(rng.choices("abcdef", k=5)) + "$$$"]) for _ in range(20)) for _ in range(10)]
        ids, counts = encoder.flat(texts)
        assert ids.tolist() == [i for t in texts for i in reference.encode(t, add_special_tokens=False).ids] and counts.sum() == len(ids)


def test_many_different_pieces_are_encoded_once(monkeypatch):
    learned, learn = [], tokenizing.Encoder._learn
    monkeypatch.setattr(tokenizing.Encoder, "_learn", lambda self, pieces, *more: learned.append(len(pieces)) or learn(self, pieces, *more))
    letters = "abcdefghijklmnopqrstuvwxyz"
    words = ["".join(letters[k // 26**j % 26] for j in range(4)) for k in range(450_000)]
    texts = [" ".join(words[k : k + 50_000]) for k in range(0, len(words), 50_000)]
    encoder = tokenizing.Encoder(TOKENIZER)
    first = [encoder.flat([t])[0].tolist() for t in texts]
    assert sum(learned) == len(words)
    assert [encoder.flat([t])[0].tolist() for t in texts] == first and sum(learned) == len(words)


def test_pieces_of_equal_hashes_are_told_apart(monkeypatch):
    reference = Tokenizer.from_file(TOKENIZER)
    hashes = tokenizing._Pieces.hashes
    monkeypatch.setattr(tokenizing._Pieces, "hashes", staticmethod(lambda data, offsets: hashes(data, offsets) % np.uint64(3)))
    encoder = tokenizing.Encoder(TOKENIZER)
    texts = ["one two three four five six", "six, five four.", "x" * 70 + " " + "y" * 70 + " one", "", "three " * 4, "ab ba aab"] * 2
    for _ in range(3):
        ids, _ = encoder.flat(texts)
        assert ids.tolist() == [i for t in texts for i in reference.encode(t, add_special_tokens=False).ids]


def test_token_files_of_nothing(spark, documents, tmp_path):
    path = f"file://{tmp_path}/tokens"
    token_files.write_tokens(documents([]), path, TOKENIZER)
    assert token_files.crc32_of_ids(token_files.with_starts(token_files.read_tokens(spark, path))).count() == 0
    with pytest.raises(ValueError):
        token_files.write_tokens(documents([]), path, TOKENIZER, encoding="plain")


def check_bins(rows, p):
    bins = {}
    for r in rows:
        bins.setdefault(r[0], []).append((r[1], r[2]))
    for placed in bins.values():
        at = 0
        for offset, length in sorted(placed):
            assert offset == at
            at += length
        cap = p.capacities
        assert at <= cap[0] and len(placed) <= cap[1] and sum(n * n for _, n in placed) <= cap[2]
    return len(bins)


@pytest.mark.parametrize("p", [packing.Packing(64), packing.Packing(64, rule="dot_product"), packing.Packing(64, max_docs=3, max_attention=900), packing.Packing(64, max_docs=2, rule="dot_product")])
def test_pieces_fill_sequences_under_every_constraint(spark, documents, p):
    rng = random.Random(3)
    texts = [None, "", *[" ".join("word" for _ in range(rng.randint(1, 200))) for _ in range(150)]]
    ids = [None, 1, 1, *range(3, len(texts))]
    got = packing.pack(documents(texts, ids), TOKENIZER, p).collect()
    check_bins([(r.sequence_id, r.offset, r.length) for r in got], p)
    of_text = encoded(texts)
    want = []
    for i, x in zip(ids, of_text, strict=True):
        begin, stop, k = 0, len(x) % p.piece or p.piece, 0
        while begin < len(x):
            want.append((i or 0, k, begin, stop - begin, zlib.crc32(x[begin:stop].tobytes())))
            begin, stop, k = stop, stop + p.piece, k + 1
    assert sorted((r.doc_id or 0, r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(want)


def test_packing_is_close_to_the_least_number():
    rng = np.random.default_rng(0)
    sizes, counts = np.unique(np.clip(rng.lognormal(6.3, 1.3, 20_000).astype(int), 1, 2048), return_counts=True)
    r = packing.recipe(dict(zip(sizes.tolist(), counts.tolist(), strict=True)), packing.Packing())
    assert int((r["bin"] + 1).max()) <= 1.01 * np.ceil((sizes * counts).sum() / 2048) + 20
    assert packing.recipe({}, packing.Packing())["length"].size == 0


def test_packing_of_nothing(spark, documents):
    assert packing.pack(documents([]), TOKENIZER).count() == 0


# --- The pipeline


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline
    from varve.llm import decontaminate

    rng = random.Random(6)
    common = "the of and to a in is that it for".split()
    prose = lambda n: " ".join(rng.choice(common) if rng.random() < 0.5 else "".join(rng.choices("etaoinshr", k=6)) for _ in range(n))
    clean = [prose(rng.randint(60, 900)) for _ in range(60)]
    # A passage of 51 short words has 250 bytes or so.
    passage, item = " ".join(rng.choice(common) if rng.random() < 0.4 else "".join(rng.choices("etaoinshr", k=5)) for _ in range(51)), prose(40)
    assert 160 < len(passage) < 400
    texts = [*clean, clean[0], clean[1].replace("the", "of", 1), "junk $$$ %%% " * 3, None, prose(200) + " " + passage, prose(300) + " " + passage, prose(100) + " " + item + " " + prose(100)]
    docs = spark.createDataFrame([(k, t, "en", "s", len(t or "")) for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"file://{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"file://{tmp_path}/benchmark.parquet")
    sf = f"file://{tmp_path}"
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "simhash_near_dedup", "suffix_array_dedup", "benchmark_decontamination", "best_fit_packing"]
    at = docs
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        at = spark.createDataFrame(stage(spark, at, sf).collect(), docs.schema)
        assert at.columns == docs.columns
        left = {r.doc_id: r.text for r in at.collect()}
        if k == 0:
            assert set(left) == set(range(62)) | {64, 65, 66}
        if k == 1:
            assert 60 not in left and 0 in left
        if k == 2:
            assert all(passage[5:-5] not in t for t in left.values())
    assert not decontaminate.match(at, spark.createDataFrame([(1, item)], "item_id long, text string")).where("contaminated").count()
    packed = corpus_pipeline.run(spark, sf).collect()
    check_bins([(r.sequence_id, r.offset, r.length) for r in packed], packing.Packing())
    want = {(k, zlib.crc32(x[: len(x) % 2048 or 2048].tobytes())) for k, x in zip(left, encoded(list(left.values())), strict=True)}
    assert {(r.doc_id, r.ids_crc32) for r in packed if r.piece == 0} == want


def test_pipeline_of_awkward_tables(spark, tmp_path):
    import corpus_pipeline

    schema = "doc_id long, text string, lang string, source string, n_chars long, spans string, kept boolean, whole int, fp string, row string"
    spark.createDataFrame([(1, "item words " * 10)], "item_id long, text string").write.parquet(f"file://{tmp_path}/a/benchmark.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"file://{tmp_path}/b/benchmark.parquet")
    rng = random.Random(9)
    text = " ".join(rng.choices("the of and to a in is that it for on with as by".split(), k=300))
    awkward = [(None, text, None, None, None, "x", True, 1, "y", "z"), (1, None, "en", "s", None, None, None, None, None, None), (2, "", "en", "s", 0, "x", False, 2, "y", "z"), (None, text, None, None, None, "x", True, 1, "y", "z")]
    for folder, rows in (("a", awkward), ("b", []), ("b2", [(k, None, None, None, None, None, None, None, None, None) for k in range(5)])):
        base = folder[0]
        spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(f"file://{tmp_path}/{base}/documents.parquet")
        packed = corpus_pipeline.run(spark, f"file://{tmp_path}/{base}")
        assert packed.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
        docs = spark.read.parquet(f"file://{tmp_path}/{base}/documents.parquet")
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = spark.createDataFrame(stage(spark, docs, f"file://{tmp_path}/{base}").collect(), schema)
            assert docs.columns == [c.split()[0] for c in schema.split(", ")]
        assert packed.count() == docs.count() == (1 if folder == "a" else 0)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
def test_queries_with_sql_match_it(spark):
    import duckdb

    from varve.llm.queries import ORACLES, QUERIES

    con, sf = duckdb.connect(), "/root/testdata/sf0.001"
    for f in os.listdir(sf):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{sf}/{f}'")
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11))
    for name, sql in ORACLES.items():
        got, want = QUERIES[name](spark, sf).toPandas(), con.execute(sql).fetchdf()
        key = lambda df: sorted(map(repr, df[sorted(df.columns)].astype(object).where(df.notna(), None).values.tolist()))
        assert sorted(got.columns) == sorted(want.columns) and key(got) == key(want)
