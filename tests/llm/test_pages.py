"""Main text of pages and WARC archives."""

import gzip
import hashlib
import html as entities
import random
import re

from runlens.llm import html_text, warc

SF = "/root/testdata/sf0.01"
PAGE = "page_id long, url string, html string, payload string, id long, tags map<string,string>, main string"


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "p", 3, {"a": "b"}, "m") for i, u, h in rows], PAGE)


def test_extract_gives_the_article_of_every_page(spark):
    rows = spark.read.parquet(f"{SF}/pages.parquet")
    got = {r["page_id"]: r for r in html_text.extract(rows).collect()}
    for r in rows.collect():
        body = re.search(r"<article>(.*)</article>", r["html"], re.S)[1]
        blocks = [" ".join(entities.unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in re.split(r"</?p>|<br>|</?h1>", body)]
        want = "\n".join(b for b in blocks if b)
        assert got[r["page_id"]]["main_text"] == want and got[r["page_id"]]["main_chars"] == len(want)


def test_extract_awkward_pages(spark):
    boilerplate = ('<header class="top"><a href=x>Site</a></header><nav><ul><li>Menu</ul></nav><div id="cookie-bar">We use cookies</div>'
                   '<div class=sidebar><p>Many side words stand here for you</p></div>')
    tail = ('<section id="comments"><article class="comment"><p>I like it very much indeed</p></article></section>'
            '<form><label>Name</label><input><button>Go</button></form><footer>&copy; all</footer>')
    body = "<h2>Head &amp; line</h2><p>First&nbsp;para <b>bo</b>ld\n  text<ul><li>one<li>two</ul><table><tr><td>c<td>d</table>"
    want = "Head & line\nFirst para bold text\none\ntwo\nc\nd"
    rows = [
        (1, "u", f"<body>{boilerplate}<article>{body}<div class='ad-box'>Buy</div><p>Last</p></article>{tail}"),
        (2, "u", f"<body>{boilerplate}<div class=post>{body}<aside>No</aside><p>Last</div>{tail}"),
        (3, None, None), (4, "u", ""), (5, "u", "plain &lt;text&gt;  of\none"), (6, "u", "<script>var a='<p>x</p>'</script><!-- <p>c</p> -->"),
        (7, "u", "<p>" + "word " * 50000), (8, "u", "<div class=comments><p>All is here"), (9, "u", "<<<>>> < a"), (1, "u", "<p>again</p>"),
        (None, "u", "<main><p>In main</p></main><p>out</p>"), (10, "u", "<article><p>Big one here now</p></article><article class=x><p>s</p></article>"),
        (11, "u", "<nav><ul><li>x<article><p>Never closed menu</p></article>"),
    ]
    out = html_text.extract(pages(spark, rows))
    assert out.columns == [*pages(spark, rows).columns, "main_text", "main_chars"]
    got = {}
    for r in out.collect():
        got.setdefault(r["page_id"], []).append(r["main_text"])
        assert r["main_chars"] == len(r["main_text"])
    assert got[2] == [want + "\nLast"] and sorted(got[1]) == sorted([want + "\nLast", "again"])
    assert got[3] == got[4] == got[6] == [""] and got[5] == ["plain <text> of one"]
    assert got[7] == [" ".join(["word"] * 50000)] and got[8] == ["All is here"] and got[None] == ["In main"]
    assert got[10] == ["Big one here now"] and got[11] == ["Never closed menu"]
    assert html_text.extract(spark.createDataFrame([], PAGE)).count() == 0


def plain_text(page, weights=None):
    return html_text.main_text(page, weights or html_text.PRIOR)


def test_attributes_count_by_their_whole_name():
    want = "First words here\nlast words here"
    for given in ('style="overflow:hidden"', 'data-hidden="false"', 'alt="the hidden valley"', "title='it is hidden'", 'href="/hidden-valley"',
                  'href="/class/search-engines"', "href=/id/search", 'data-class="sidebar"', 'data-id=ad', 'title="role=navigation"',
                  'title="style=display:none"', 'style="--display:none"', 'aria-hidden="false"', "title = 'a > hidden b' lang=en"):
        assert plain_text(f"<div><p>First words here</p><p {given}>last words here</p></div>") == want, given
        assert plain_text(f"<div {given}><p>First words here</p><p>last words here</p></div>") == want, given
        assert plain_text(f"<p>First <a {given}>words</a> here<p>last words here") == want, given
    for given in ("hidden", "lang=en HIDDEN", 'hidden=""', 'aria-hidden="true"', "role='navigation'", 'ROLE=banner', 'class="ad"', "class = 'ad'",
                  'id=cookie-bar', 'style="color:red; display : none"', "style=display:none", 'href="/x"class="ad"', 'title="class=x" class="ad"'):
        assert plain_text(f"<p>First words here</p><div {given}>gone</div><p>last words here</p>") == want, given


def test_scan_chooses_over_the_whole_page(spark):
    rows = spark.read.parquet(f"{SF}/pages.parquet")
    weights = html_text.learn(rows)
    assert 0.2 < weights["word"] < 2.0 and weights["<li"] == weights["<article"] == -3.0 and weights["<p"] == -0.01
    for r in rows.limit(60).collect():  # without the mark the scan finds the same text
        bare = re.sub(r"<(/?)article>", r"<\1div>", r["html"])
        assert html_text.main_text(bare, weights) == html_text.main_text(r["html"], weights) != ""
    words = lambda name, n: " ".join(f"{name}{i}" for i in range(n))
    nav = "<nav><ul>" + "<li><a href=/x>menu</a></li>" * 8 + "</ul></nav>"
    a, b, c = words("a", 30), words("b", 25), words("c", 40)
    parts = html_text.main_text(f"<body>{nav}<article><p>{a}</p></article><article><p>{b}</p></article><article><p>{c}</p></article>", weights)
    assert parts == f"{a}\n{b}\n{c}"
    cards = "".join(f"<article><a href=/t{i}>Teaser {i}</a></article>" for i in range(4))
    links = "<ul>" + "".join(f"<li><a href=/l>link {i}</a></li>" for i in range(20)) + "</ul>"
    listed = "\n".join(f"link {i}" for i in range(20))
    assert html_text.main_text(f"<body>{nav}<div class=content><p>{c}</p><p>{a}</p></div>{cards}", weights) == f"{c}\n{a}"
    assert html_text.main_text(f"<body>{nav}<ul><li>Up<li>Down</ul><p>{c}</p><ul><li>Top</ul>", weights) == c
    for tag in ("article", "main", "div"):  # links inside the article cost no text of it
        assert html_text.main_text(f"<body>{nav}<{tag}><p>{a}</p>{links}<p>{c}</p></{tag}>", weights) == f"{a}\n{listed}\n{c}"


def test_names_that_only_hint_drop_no_article_text(spark):
    weights = html_text.learn(spark.read.parquet(f"{SF}/pages.parquet"))
    first, mid, last = (" ".join(f"{name}{i}" for i in range(30)) for name in "fml")
    want = f"{first}\n{mid}\n{last}"
    hints = ('<section id="discussion">', '<section id="side-effects">', '<div id="related-work">', '<h2 id="search-algorithms">', '<h2 id="cookies">',
             '<p class="legal-history">', '<div class="notice">', '<div class="market-share">', '<div id="ad-hoc">', '<p id="reply">', '<div class="form tags">')
    sure = ('<div class="ad-slot">', '<div id="cookie-bar">', '<div class="share-bar">', '<ol class="comment-list">', '<section id="comments">', '<div class=ads>')
    for around in ("article", "main", "div class=post"):
        for tag in hints + sure:
            part = f"{tag}{mid}</{tag[1:].split()[0]}>"
            close = around.split()[0]
            keeps = want if tag in hints else f"{first}\n{last}"
            assert html_text.main_text(f"<{around}><p>{first}</p>{part}<p>{last}</p></{close}>", weights) == keeps, (around, tag)
        if around == "article":  # at the end of a marked article too
            for tag in hints:
                assert html_text.main_text(f"<article><p>{first}</p>{tag}{mid}</{tag[1:].split()[0]}></article>", weights) == f"{first}\n{mid}", tag
    side = "<div class=sidebar><p>Many side words stand here for you</p></div><div class='related posts'>More words to read on</div>"
    assert html_text.main_text(f"{side}<article><p>{first}</p></article>{side}", weights) == first
    assert html_text.main_text(f"<div>{side}<div><p>{first}</p></div>{side}</div>", weights) == first
    assert html_text.main_text(f"<div class=page-sidebar><article><p>{first}</p></article></div><p>x y", weights) == first
    assert html_text.main_text("<div class=sidebar><p>All is here</p></div>", weights) == "All is here"


def test_dropped_parts_in_mid_sentence_end_no_block():
    article = lambda inner: f"<html><body><article><p>{inner}</p></article></body></html>"
    for part in ("<script>x()</script>", "<svg><text>v</text></svg>", "<label>l</label>", "<button>b</button>", "<span class=ad>buy</span>"):
        assert plain_text(article(f"One two {part} three four")) == "One two three four", part
    assert plain_text(article("with <math><mi>a</mi><mo>=</mo><mi>b</mi><annotation>tex</annotation></math> it holds")) == "with a=b it holds"
    assert plain_text(article("One two<br>three")) == "One two\nthree"


def test_attributes_of_any_length_and_stray_quotes():
    article = lambda inner: f"<html><body><article><p>{inner}</p></article></body></html>"
    for n in (10, 5000, 200_000):
        assert plain_text(article(f"go <a title='{'y' * n} > z'>link</a> on <img src=\"data:image/svg+xml,<svg {'p' * n}>\" alt=x> end")) == "go link on end"
    assert plain_text(article("it <a href=\"x>is</a> not <a href=\"y\">lost</a> here")) == "it is not lost here"
    assert plain_text(article("it <b it's>is</b> don't")) == "it is don't"
    assert plain_text(article("one <a title='never closed>two</a> three")) == "one two three"
    many = "<a title='x>w</a> " * 20_000
    assert plain_text(article(many)).count("w") == 20_000


def test_boxes_inside_a_marked_article_go():
    text = "<p>" + "some words of the story go on and on here " * 4 + "</p>"
    want = " ".join(text[3:-4].split())
    for name in ("newsletter", "newsletter-box", "related-posts", "sidebar", "sponsored", "sponsored-links", "promo"):
        page = f'<html><body><article>{text}<div class="{name}">Off the story, sign up now</div>{text}</article></body></html>'
        assert plain_text(page) == want + "\n" + want, name
    for tag, name in (("section", 'id="related"'), ("h2", 'class="notice"'), ("div", 'class="related-work"'), ("div", 'class="discussion"')):
        page = f'<html><body><article>{text}<{tag} {name}>Part of the story</{tag}>{text}</article></body></html>'
        assert plain_text(page) == "\n".join((want, "Part of the story", want)), name
    page = f'<html><body><article>{text}</article><div class="responses">{"<p>I liked that a lot</p>" * 6}</div></body></html>'
    assert plain_text(page) == want


def test_region_is_the_maximum():
    r = random.Random(2)
    for _ in range(200):
        values = [r.choice([-3.0, -1.0, -0.5, 1.0, 2.0]) for _ in range(r.randrange(1, 14))]
        start, stop = html_text.best_region(values)
        most = max(sum(values[a:b]) for a in range(len(values)) for b in range(a, len(values) + 1))
        assert sum(values[start:stop]) == max(0.0, most)


def html_rows():
    big = "<p>é " + "x" * 1500 + "</p>"
    return [(1, "http://a/ b\r\nc", big), (2, None, big), (3, "u", "tiny"), (4, "u", "tiny"), (5, "u", None), (6, "u", ""),
            (7, "u", "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 2\r\n\r\nhi\r\n\r\n" + "y" * 1200), (None, "u", big),
            (None, "u", "z" * 1100), (8, "u", "q" * 1000), (9, "u", "q" * 1000), (9, "u", "q" * 1000), (10, "u", "line\r\n\r\n\r\n\r\n" * 400)]


def truth(rows):
    payload = [(h or "").encode() for _, _, h in rows]
    out = []
    for (i, _, _), p in zip(rows, payload):
        same = [k for (k, _, _), q in zip(rows, payload) if q == p and k is not None]
        keeper = max(same) if same and len(p) >= 1000 and payload.count(p) > 1 else None
        revisit = keeper is not None and keeper != i
        out.append((i, len(p), hashlib.sha1(p).hexdigest(), "revisit" if revisit else "response", keeper if revisit else None))
    return sorted(out, key=str)


def back(df):
    ident = lambda u: None if not u or u == f"<{warc.URN}>" else int(u[len(warc.URN) + 1:-1])
    return sorted(((ident(r["record_id"]), r["payload_bytes"], r["payload_digest"], r["record_type"], ident(r["refers_to"]))
                   for r in df.where("kind = 'record'").collect()), key=str)


def test_archives_round_trip(spark, tmp_path):
    rows = html_rows()
    for per in (2, 1000):
        path = str(tmp_path / f"w{per}")
        warc.write_archives(pages(spark, rows), path, records_per_archive=per)
        got = warc.read_archives(spark, path)
        assert back(got) == truth(rows) and got.where("kind = 'gap'").count() == 0
        texts = {bytes(r["payload"]) for r in got.collect() if r["payload"] is not None}
        assert texts == {(h or "").encode() for _, _, h in rows}
    path = str(tmp_path / "none")
    warc.write_archives(spark.createDataFrame([], PAGE), path)
    assert warc.read_archives(spark, path).where("kind = 'record'").count() == 0


def record(k, payload):
    block = b"HTTP/1.1 200 OK\r\n\r\n" + payload
    return (f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <{warc.URN}{k}>\r\nWARC-Payload-Digest: sha1:"
            f"{hashlib.sha1(payload).hexdigest()}\r\nContent-Type: application/http\r\nContent-Length: {len(block)}\r\n\r\n").encode() + block + b"\r\n\r\n"


def number(r):
    return int(r["record_id"][len(warc.URN) + 1:-1])


def covered(data, rows):
    at = 0
    for r in sorted({(r["start"], r["stop"]) for r in rows}):
        assert r[0] == at
        at = r[1]
    assert at == len(data)


def test_salvage_goes_on_after_damage():
    parts = [record(k, bytes([65 + k]) * 300) for k in range(6)]
    plain = b"".join(parts)
    edge = [sum(map(len, parts[:k])) for k in range(7)]
    cases = {
        "flipped byte": (plain[:edge[2] + 300] + b"\x00" + plain[edge[2] + 301:], [0, 1, 3, 4, 5], [(edge[2], edge[3])]),
        "cut record": (plain[:edge[1] + 200] + plain[edge[2]:], [0, 2, 3, 4, 5], None),
        "bad length": (plain[:edge[3]] + plain[edge[3]:edge[4]].replace(b"Content-Length: ", b"Content-Length: x") + plain[edge[4]:], [0, 1, 2, 4, 5], None),
        "noise between": (plain[:edge[2]] + b"noise\x1f\x8b\x08 noise" + plain[edge[2]:], [0, 1, 2, 3, 4, 5], [(edge[2], edge[2] + 14)]),
        "cut end": (plain[:-20], [0, 1, 2, 3, 4], None),
        "noise first": (b"??" + plain, [0, 1, 2, 3, 4, 5], [(0, 2)]),
    }
    for name, (data, want, gaps) in cases.items():
        rows = list(warc.salvage(data))
        assert [number(r) for r in rows if r["kind"] == "record"] == want, name
        holes = [(r["start"], r["stop"]) for r in rows if r["kind"] == "gap"]
        assert holes if gaps is None and len(want) < 6 else holes == (gaps or []), name
        assert all(r["reason"] for r in rows if r["kind"] == "gap")
        covered(data, rows)


def test_salvage_is_linear_in_damage():
    for piece in (b"WARC/1.0\r\nbroken\r\n", b"\x1f\x8b\x08 no member at all, not even close to one ....."):
        data = piece * 40_000
        rows = list(warc.salvage(data + record(1, b"sound")))
        assert [r["kind"] for r in rows] == ["gap", "record"] and rows[0]["stop"] == len(data) == rows[1]["start"]


def test_salvage_gzip_members():
    parts = [gzip.compress(record(k, bytes([97 + k]) * 500)) for k in range(5)]
    whole = b"".join(parts)
    assert [number(r) for r in warc.salvage(whole)] == [0, 1, 2, 3, 4]
    broken = parts[0] + parts[1][:30] + b"\xff" + parts[1][31:] + parts[2] + parts[3][:-12] + parts[4]
    rows = list(warc.salvage(broken))
    assert [number(r) for r in rows if r["kind"] == "record"] == [0, 2, 4]
    covered(broken, rows)
    mixed = parts[0] + record(7, b"plain") + parts[1]
    assert [number(r) for r in warc.salvage(mixed)] == [0, 7, 1]
    two = gzip.compress(record(1, b"one") + b"junk" + record(2, b"two"))
    assert [(r["kind"]) for r in warc.salvage(two)] == ["record", "gap", "record"]
    assert list(warc.salvage(b"")) == []


def test_salvage_reads_damaged_files_through_spark(spark, tmp_path):
    parts = [record(k, bytes([65 + k]) * 300) for k in range(4)]
    (tmp_path / "a.warc").write_bytes(parts[0] + parts[1][:100] + parts[2])
    (tmp_path / "b.warc.gz").write_bytes(gzip.compress(parts[3]))
    (tmp_path / "empty.warc").write_bytes(b"")
    rows = warc.read_archives(spark, str(tmp_path)).collect()
    assert sorted(number(r) for r in rows if r["kind"] == "record") == [0, 2, 3]
    assert [(r["start"], r["stop"]) for r in rows if r["kind"] == "gap"] == [(len(parts[0]), len(parts[0]) + 100)]


def test_urls_of_any_content_come_back(spark, tmp_path):
    big = "<p>" + "k" * 1500 + "</p>"
    rows = [(1, "http://a/WARC/1.1", big), (2, "http://a/WARC/1.0/b", big), (9, "http://a/WARC/1.1", big), (3, "http://a/?q=" + "x" * 70000, "long"),
            (4, "http://a/WARC/1.1\r\nWARC/1.0\r\n\r\n", "lines"), (5, "WARC/1.1", "plain"), (6, "u", "after"), (7, "http://b/" + " " * 40000, big + "7")]
    path = str(tmp_path / "urls")
    warc.write_archives(pages(spark, rows), path)
    got = warc.read_archives(spark, path)
    assert back(got) == truth(rows) and got.where("kind = 'gap'").count() == 0
    urls = {r["record_id"]: r["url"] for r in got.collect()}
    assert urls == {f"<{warc.URN}{i}>": re.sub(r"[\x00-\x20\x7f]", "%20", u) for i, u, _ in rows}


def test_headers_that_run_together_are_a_gap():
    first, second, third = (record(k, bytes([65 + k]) * 300) for k in range(3))
    head = first.index(b"\r\n\r\n")
    for cut in range(1, head + 2):
        rows = list(warc.salvage(first[:cut] + second + third))
        assert [number(r) for r in rows if r["kind"] == "record"] == [1, 2], cut
        covered(first[:cut] + second + third, rows)


def test_archives_are_bounded_by_bytes(spark, tmp_path):
    rows = [(i, "u", f"{i} " + "y" * (20000 if i % 10 == 0 else 300000 if i == 55 else 100)) for i in range(100)]
    path = tmp_path / "sized"
    warc.write_archives(pages(spark, rows).coalesce(1), str(path), records_per_archive=64, bytes_per_archive=100000)
    assert back(warc.read_archives(spark, str(path))) == truth(rows)
    for file in path.glob("part-*"):
        found = [r for r in warc.salvage(file.read_bytes()) if r["kind"] == "record"]
        assert len(found) == 1 or file.stat().st_size <= 100000 and len(found) <= 64
    assert len(list(path.glob("part-*"))) < 20
