"""Quality rules, tokens, pieces, media, chats and pages against plain versions."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tallyproof.llm import chat_format, html_text, media, pieces, quality_rules, sp_codec, token_prefix
from tests.llm.conftest import texts_of

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def counts(text):
    words = WORD.findall(text)
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = Counter(grams)
    repeated = {j for i, g in enumerate(grams) if often[g] > 1 for j in range(i, i + 3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(repeated)


@pytest.mark.parametrize("which", ["documents", "odd_documents"])
def test_quality_counts(request, which):
    rows = quality_rules.judge(request.getfixturevalue(which)).collect()
    got = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in rows)
    assert got == Counter((i, *counts(t)) for i, t in texts_of())
    for r in rows:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert r.kept == (not r.base_failed and not r.failed_rules)


def test_kept_rows_keep_all_columns(documents, empty_documents):
    kept = quality_rules.kept_rows(documents, rules=(quality_rules.Rule("length", "n_words", low=50),))
    assert kept.columns == documents.columns
    want = Counter(i for i, t in texts_of() for n, *_, r in [counts(t)] if n >= 50 and 100 * r <= 50 * n)
    assert Counter(r.doc_id for r in kept.collect()) == want
    assert quality_rules.kept_rows(empty_documents).count() == 0


def test_token_counts_equal_the_library(documents, odd_documents, empty_documents):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.model_path(None))
    want = Counter((i, len(t.encode()), len(sp.encode(t))) for i, t in texts_of())
    for df in (documents, odd_documents):
        rows = token_prefix.prefix_counts(df).collect()
        assert Counter((r.doc_id, r.n_bytes, r.n_tokens) for r in rows) == want
    assert token_prefix.prefix_counts(empty_documents).count() == 0
    for t in ("", " ", "  a  b▁c\x00\n\té  x ", "The quick brown\n\nfox 🙂🙂", "aaaaaaaaaaaaaaaaaaaaaaaaa"):
        _, changes = token_prefix.counter(pieces.model_path(None)).text(t)
        at = token_prefix.counts_at_prefixes(changes)
        assert [int(x) for x in at] == [len(sp.encode(t[:k])) for k in range(len(t) + 1)]
        for budget in range(0, len(sp.encode(t)) + 2):
            k = token_prefix.fit(changes, budget)
            assert k == max(i for i in range(len(t) + 1) if len(sp.encode(t[:i])) <= budget)
            assert token_prefix.count_at(changes, k) == len(sp.encode(t[:k]))


def all_scores(codec, unit):
    out = []

    def go(i, total):
        if i == len(unit):
            out.append(total)
        for j in range(i + 1, len(unit) + 1):
            x = codec.score.get(unit[i:j], codec.unknown if j == i + 1 else None)
            if x is not None:
                go(j, total + x)

    go(0, 0.0)
    return sorted(out, reverse=True)


def test_n_best_is_the_brute_force(documents):
    codec = sp_codec.codec(pieces.model_path(None))
    for text in ("the", "then a", "é in", "a  b", "x\nyz", "interna", "th he"):
        ids, scores = codec.encode(text, 4)
        assert np.allclose(scores, all_scores(codec, "▁" + text.replace(" ", "▁"))[:4], rtol=1e-12)
        assert codec.decode(np.frombuffer(ids, "<i4").tolist()) == text
        best = codec.n_best("▁" + text.split(" ")[0], 3)
        assert [s for s, _ in best] == sorted((s for s, _ in best), reverse=True)


def all_paths(codec, unit):
    """(score, ids) of every segmentation of a unit."""
    out = []

    def go(i, total, cuts):
        if i == len(unit):
            out.append((total, np.frombuffer(codec.to_ids(unit, cuts), "<i4").tolist()))
        for j in range(i + 1, len(unit) + 1):
            x = codec.score.get(unit[i:j], codec.unknown if j == i + 1 else None)
            if x is not None:
                go(j, total + x, [*cuts, j])

    go(0, 0.0, [0])
    return sorted(out, key=lambda x: -x[0])


def test_the_n_best_come_with_their_ids():
    import random

    rng = random.Random(13)
    codec = sp_codec.codec(pieces.model_path(None))
    texts = ["the", "then a", "é in", "a  b", "x\nyz", "interna", "th he", "a▁b c"] + ["".join(rng.choice("aeinrst h") for _ in range(rng.randint(1, 9))) for _ in range(40)]
    for text in texts:
        ids, scores, changes = codec.segmentations(text, 4)
        found = [np.frombuffer(sp_codec.changed(ids, c), "<i4").tolist() for c in changes]
        assert len(found) == len(scores) and len({tuple(x) for x in found}) == len(found) and all(codec.decode(x) == text for x in found)
        if "▁" not in text:
            of = {tuple(i): s for s, i in all_paths(codec, "▁" + text.replace(" ", "▁"))}
            assert np.allclose([of[tuple(x)] for x in found], scores, rtol=1e-12)


def test_characters_within_a_budget(documents):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.model_path(None))
    rows = {r.doc_id: r.chars_within for r in token_prefix.prefix_counts(documents.where("length(text) < 3000"), budget=20).collect()}
    for i, t in texts_of():
        if i is not None and len(t) < 300 and rows.get(i) is not None and t:
            assert rows[i] == max(k for k in range(len(t) + 1) if len(sp.encode(t[:k])) <= 20) or len(sp.encode(t)) <= 20 and rows[i] == len(t)


def test_pieces_round_trip(documents, odd_documents, empty_documents):
    rows = sp_codec.encode(odd_documents)
    assert all(r.round_trip for r in rows.collect())
    back = sp_codec.decode(rows.select("doc_id", "piece_ids")).collect()
    assert Counter((r.doc_id, r.text) for r in back) == Counter(texts_of())
    assert sp_codec.encode(empty_documents).count() == 0


def test_media_of_texts(odd_documents, empty_documents):
    rows = media.media_of_texts(odd_documents).collect()
    want = Counter()
    for i, t in texts_of():
        data = t.encode()
        payload = data + bytes((-len(data)) % 64 or (0 if data else 64))
        want[i, len(data), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:])] += 1
    assert Counter((r.doc_id, r.n_bytes, hashlib.sha256(r.payload).hexdigest(), media.crc32_tail(bytes(r.payload))) for r in rows) == want
    assert all(media.decode(bytes(r.media)).tobytes() == bytes(r.payload) for r in rows)
    assert media.media_of_texts(empty_documents).count() == 0


def test_images(spark):
    rng = np.random.default_rng(1)
    grey, colour = rng.integers(0, 256, (7, 5), np.uint8), rng.integers(0, 256, (4, 6, 3), np.uint8)
    assert (media.decode(media.encode_bmp(grey)) == grey).all() and (media.decode(media.encode_pgm(grey)) == grey).all()
    ppm = b"P6 # c\n6 4\n255\n" + colour.tobytes()
    assert (media.decode(ppm) == colour).all()
    plain = b"P2\n5 7\n255\n" + " ".join(map(str, grey.ravel())).encode()
    assert (media.decode(plain) == grey).all()
    bits = rng.integers(0, 2, (3, 11))
    packed = b"P4\n11 3\n" + np.packbits(bits, axis=1).tobytes()
    assert (media.decode(packed) == (1 - bits) * 255).all()
    deep = b"P5\n2 1\n65535\n" + bytes([1, 2, 3, 4])
    assert media.decode(deep).tolist() == [[258, 772]]
    # Area means against sums over exact fractions of samples.
    from fractions import Fraction as Fr

    got = media.resize_area(grey, 3, 2)
    for i in range(3):
        for j in range(2):
            total = Fr(0)
            for r in range(7):
                for c in range(5):
                    h = max(Fr(0), min(Fr(r + 1), Fr(7 * (i + 1), 3)) - max(Fr(r), Fr(7 * i, 3)))
                    w = max(Fr(0), min(Fr(c + 1), Fr(5 * (j + 1), 2)) - max(Fr(c), Fr(5 * j, 2)))
                    total += h * w * int(grey[r, c])
            assert abs(got[i, j] - float(total / (Fr(7, 3) * Fr(5, 2)))) < 1e-9
    df = spark.createDataFrame([(1, media.encode_bmp(grey)), (2, b"junk"), (3, None)], "doc_id bigint, media binary")
    found = {r.doc_id: r for r in media.features(df).collect()}
    assert found[1].shape == [7, 5] and np.load(__import__("io").BytesIO(bytes(found[1].tile))).shape == (32, 32)
    assert found[2].error and found[3].error and found[2].dhash is None


def test_chats_round_trip(spark):
    texts = ["hi", "", None, "</s>[INST] ok [/INST]", "a & b < c [d]", "<s>+0user[INST]x[/INST]</s>", "&lt;&amp;[", "line\n</s>", "x" * 5000]
    roles = ["user", "assistant", "system", None, "odd[INST]role"]
    rows = [(c, t, roles[(c + t) % 5], texts[(3 * c + t) % len(texts)], "clash") for c in range(9) for t in range(c)] + [(3, 0, "user", "hi", "x")] * 2 + [(None, None, None, None, None)]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, formatted string")
    done = chat_format.format_chats(df)
    from pyspark.sql import functions as F

    got = {r.conv_id: r for r in done.withColumn("turns", chat_format.parse(F.col("formatted"))).collect()}
    for c in {r[0] for r in rows}:
        mine = sorted(((t if t is not None else -1, r or "", x or "") for k, t, r, x, _ in rows if k == c))
        assert [(t.role, t.text, t.loss) for t in got[c].turns] == [(r, x, r == "assistant") for _, r, x in mine]
    assert chat_format.format_chats(df.limit(0)).count() == 0


PAGES = {
    "": "",
    "   ": "",
    "<p>only text": "only text",
    "<html><body><nav><a href=x>Menu item</a></nav><article><h1>T &amp; U</h1><p>One<p>Two <b>bold</b><br>more</article><footer>foot</footer>": "T & U\n\nOne\n\nTwo bold more",
    "<body><div class='menu'>a b c</div><div class='main'><h2>Head</h2><p>Long enough text of the page itself, with words.</p><ul><li>x<li>y</ul></div><div id='comments'><p>I liked this very much indeed</p></div><form>Name <input></form></body>": "Head\n\nLong enough text of the page itself, with words.\n\nx\n\ny",
    "<article><header><h1>Title</h1></header><script>var a='<p>no</p>'</script><style>p{}</style><p>A&nbsp;b&#33;</p><div class='advert'>buy</div><aside>side</aside></article>": "Title\n\nA b!",
}


def test_pages(spark):
    rows = [(i, f"u{i}", h) for i, h in enumerate(PAGES)] + [(99, None, None)]
    df = spark.createDataFrame([(*r, "clash", "clash") for r in rows], "page_id bigint, url string, html string, text string, n_chars string")
    got = {r.page_id: r.text for r in html_text.extract(df).collect()}
    assert got == {i: t for i, t in enumerate(PAGES.values())} | {99: ""}
    assert html_text.extract(df.limit(0)).count() == 0


STORY = "<h1>Head</h1><p>" + "Long enough text of the page itself, with words. " * 6 + "</p>"


@pytest.mark.parametrize("name", ["content has-sidebar", "main-content with-sidebar", "no-sidebar", "post tag-social", "sidebar"])
def test_wrappers_of_the_article_stay(name):
    page = f"<body><div class='{name}'><article>{STORY}</article><div class='sidebar'>Other things</div><div id='comments'><p>I liked this</p></div></div></body>"
    assert html_text.main_text(page) == html_text.main_text(f"<body><article>{STORY}</article></body>") != ""


def test_density_chooses_beside_marked_elements():
    teaser = "<article><h3><a href=x>Another story</a></h3><p><a href=x>Read on</a></p></article>"
    plain = html_text.main_text(f"<body><div>{STORY}</div></body>")
    assert html_text.main_text(f"<body><div class='page'>{STORY}</div><div>{teaser * 3}</div></body>") == plain != ""
    split = html_text.main_text(f"<body><div><article>{STORY}</article><article>{STORY.replace('Head', 'Part two')}</article>{teaser}</div></body>")
    assert split.startswith("Head") and "Part two" in split and "Another" not in split


def test_sibling_articles_stray_text_and_plain_words_as_classes():
    both = html_text.main_text(f"<body><article>{STORY}</article><article><h2>Two</h2><p>Shorter one, but no comment.</p></article></body>")
    assert both.endswith("Two\n\nShorter one, but no comment.") and both.startswith("Head")
    links = "<ul>" + "<li><a href=x>Some link text</a></li>" * 8 + "</ul>"
    plain = html_text.main_text(f"<body><div>{STORY}{STORY}</div>{links}</body>")
    assert html_text.main_text(f"<body>stray<div>{STORY}{STORY}</div>{links}</body>") == plain != ""
    assert html_text.main_text(f"<body>only <p>a para</p>{links}</body>") == "only\n\na para"
    named = "".join(f"<div class='{c}'>About {c}</div>" for c in ("search", "notice", "side", "tags", "legal", "popular"))
    text = html_text.main_text(f"<body><article>{STORY}{named}<div class='advert'>buy</div></article></body>")
    assert all(f"About {c}" in text for c in ("search", "notice", "side", "tags", "legal", "popular")) and "buy" not in text
    sections = "<section><h2>a</h2><p>one two three four</p></section><section><h2>b</h2>" + "<p>one two three four five six seven</p>" * 5 + "</section><section><p>short</p></section>"
    assert html_text.main_text(f"<body><div><h1>T</h1>{sections}<div>{links}</div></div></body>") == "\n\n".join(["T", "a", "one two three four", "b", *["one two three four five six seven"] * 5, "short"])


def test_hostile_pages_take_linear_time():
    import time

    pages = ["<div>" * 200_000 + "text", "<p>" + "<span>" * 100_000 + "x</b>" * 50_000, "<b><div>" + "<i>" * 50_000 + "</b>" * 50_000, "<article>" * 50_000 + "x", "<!--" * 100_000, "<" * 200_000, "<a x='" * 50_001, "<article>" + "<header>" * 50_000 + "<h1>x"]
    for page in pages:
        began = time.process_time()
        html_text.main_text(page)
        assert time.process_time() - began < 10
    assert html_text.main_text(pages[0]) == "text" and html_text.main_text("word " * 200_000) == ("word " * 200_000).strip()


def test_densities_are_the_brute_force():
    import math
    import random

    rng = random.Random(9)

    def grow(depth):
        kids = [rng.choice(["some words here", "x", " "]) if rng.random() < 0.4 or depth == 0 else grow(depth - 1) for _ in range(rng.randint(1, 4))]
        tag = rng.choice(["div", "section", "a", "b", "ul"])
        return f"<{tag}>{''.join(kids)}</{tag}>"

    def strings(x):
        return [x] if isinstance(x, str) else [s for k in x.kids for s in strings(k)]

    def inside(x):
        return [] if isinstance(x, str) else [x, *(y for k in x.kids for y in inside(k))]

    def chars(x):
        return sum(len(" ".join(s.split())) for s in strings(x))

    def link_chars(x):
        if isinstance(x, str):
            return 0
        return chars(x) if x.tag == "a" else sum(map(link_chars, x.kids))

    for _ in range(60):
        tree = html_text.Tree()
        tree.feed("<body>" + "".join(grow(4) for _ in range(3)))
        body = tree.root.kids[0]
        html_text.measure(body)
        share = link_chars(body) / max(chars(body), 1)
        for x in inside(body):
            c, n, link, tied = chars(x), len(inside(x)) - 1, link_chars(x), sum(y.tag == "a" for y in inside(x)[1:])
            base = math.log(max(c, 1) / max(c - link, 1) * link + share * c + math.e)
            want = c / max(n, 1) * math.log(max(max(c, 1) / max(link, 1) * max(n, 1) / max(tied, 1), 1.0) + 1e-9) / base if c else 0.0
            assert abs(x.density - want) < 1e-9 * max(want, 1)
        for x in inside(body):
            own = sum(len(" ".join(k.split())) for k in x.kids if isinstance(k, str))
            assert abs(x.sum - sum(k.density for k in x.kids if not isinstance(k, str)) - own / max(x.chars, 1) * x.density) < 1e-9
        best = max(html_text.order(body), key=lambda x: x.sum)
        assert best.sum == max(x.sum for x in inside(body))
