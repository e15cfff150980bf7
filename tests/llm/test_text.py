import hashlib
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from ferrywake.llm import decontaminate, html_text, language, pii


def luhn(d):
    return sum((lambda v: v - 9 if v > 9 else v)(int(c) * (2 if i % 2 else 1)) for i, c in enumerate(reversed(d))) % 10 == 0


def base_spans(t):
    out = []
    for k, p in (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")):
        for m in re.finditer(p, t or ""):
            d = re.sub("[^0-9]", "", m[0])
            if k == "ip" and any(int(x) > 255 for x in m[0].split(".")) or k == "card" and not (16 <= len(d) <= 19 and luhn(d)) or k == "phone" and not 8 <= len(d) <= 15:
                continue
            out.append((k, m.start(), m.end()))
    return out


PII = [
    None, "", "write a@b.c_d@e.f now", "a.b@x.example.com.", "x@y", "1.2.3.4.5.6.7.8 and 256.1.1.1 and 0001.02.3.255", "9" * 300, "4111 1111 1111 1111 or 4111-1111-1111-1112, 4111111111111111 4111111111111111", "+1 (555) 555-1234 and +1 2 3", "é😀 a@b.co 漢 +49 30 1234567",
    "+1.2.3.4 " * 3, "12345678901234567890", "0" * 16 + " " + "0" * 19, "IBAN DE89370400440532013000 or DE89370400440532013001", 'token = "740d10cfb38a379bfbce847f43f32482d573dc8b"', "a@" * 50, "..@-.-", "1 " * 30_000, "a" * 60_000 + "@b.c", "7" * 60_000, "x1.2.3.4y", "%+-@a.b@c.d",
]


def test_pii_base_spans(make):
    got = {r.doc_id: r.spans for r in pii.find(make(list(enumerate(PII)))).collect()}
    for i, t in enumerate(PII):
        mine = [(s.kind, s.start, s.end) for s in got[i]]
        assert [s for s in mine if s[0] in ("email", "ip", "card", "phone")] == base_spans(t), (i, t and t[:50])
    assert [s.kind for s in got[13]] == ["iban"] and (got[13][0].start, got[13][0].end) == (5, 27)
    assert [s.kind for s in got[14]] == ["secret"]
    assert pii.find(make([])).count() == 0


def test_pii_query_counts_each_kind(spark, make, tmp_path):
    texts = [*PII, "a@b.c d@e.f and 1.2.3.4", "+49 30 1234567 then +49 30 7654321", "x 4111111111111111, 4111111111111111 a@b.c"]
    make(list(enumerate(texts))).write.parquet(f"{tmp_path}/documents.parquet")
    for r in pii.op3(spark, str(tmp_path)).collect():
        want = base_spans(texts[r.doc_id])
        kinds = Counter(k for k, _, _ in want)
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(kinds[k] for k in ("email", "ip", "card", "phone")), r.doc_id
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in want).encode()).hexdigest(), r.doc_id


def test_pii_scores_and_checks(spark, make):
    near, far = (r.spans[0].score for r in pii.find(make([(1, "call my phone +1 555 555 1234"), (2, "xyz +1 555 555 1234")])).orderBy("doc_id").collect())
    assert near > far > 0
    rows = spark.createDataFrame([("GB82WEST12345698765432",), ("GB82WEST12345698765433",)], "x string")
    assert [r[0] for r in rows.select(pii.mod97(F.col("x"))).collect()] == [True, False]


def test_pii_mask(make):
    df = make([(1, "mail a@b.co, card 4111111111111111."), (2, None), (3, "clean"), (4, "+1.2.3.4.5.6.7.8")])
    got = {r.doc_id: r.text for r in pii.mask(df).collect()}
    assert got[1] == "mail [EMAIL], card [CARD]." and got[2] is None and got[3] == "clean" and "[" in got[4] and pii.mask(df).columns == df.columns


def test_pii_keeps_columns_of_any_name(make):
    df = make([(1, "mail a@b.co"), (2, None)]).selectExpr("*", "1 AS `__text`", "2 AS `__spans`", "3 AS whole_", "4 AS spans_", "5 AS p_email_", "6 AS S_IP_")
    got = pii.mask(df)
    assert got.columns == df.columns and [tuple(r)[-6:] for r in got.collect()] == [(1, 2, 3, 4, 5, 6)] * 2 and {r.text for r in got.collect()} == {"mail [EMAIL]", None}


def test_pii_iban_before_other_words(make):
    texts = {
        1: ("pay DE89370400440532013000 BIC COBADEFFXXX", 4, 26), 2: ("DE89370400440532013000 Please", 0, 22), 3: ("DE89370400440532013000 2024 due", 0, 22), 4: ("GB82 WEST 1234 5698 7654 32 I think", 0, 27),
        5: ("NO93 8601 1117 947 A1", 0, 18), 6: ("ZZ12 AB DE89370400440532013000", 8, 30),
    }
    got = {r.doc_id: [(s.start, s.end) for s in r.spans if s.kind == "iban"] for r in pii.find(make([(i, t[0]) for i, t in texts.items()])).collect()}
    assert got == {i: [t[1:]] for i, t in texts.items()}
    masked = {r.doc_id: r.text for r in pii.mask(make([(1, texts[1][0])])).collect()}
    assert masked == {1: "pay [IBAN] BIC COBADEFFXXX"}


def test_pii_long_secrets(make):
    keys = ["a1" * 150, "x" * 300 + "7" + "y" * 20, "k9" * 50_000]
    got = {r.doc_id: [(s.kind, s.start, s.end) for s in r.spans if s.kind == "secret"] for r in pii.find(make([(i, f"token {k} end") for i, k in enumerate(keys)])).collect()}
    assert got == {i: [("secret", 6, 6 + len(k))] for i, k in enumerate(keys)}


def test_main_text_in_several_blocks():
    f = html_text.main_text
    parts = [[f"{w} {i} " + "words of the text " * 16 for i in range(3)] for w in ("first", "second")]
    block = ["<div>" + "".join(f"<p>{t}</p>" for t in p) + "</div>" for p in parts]
    want = "\n".join(t.strip() for p in parts for t in p)
    links = "<div>" + "<a href=x>one link</a> " * 9 + "</div>"
    assert f(f"<body>{links}<div id=content>{block[0]}{block[1]}</div>{links}</body>") == want
    assert f(f"<body>{links}<div id=content>{block[0]}<h2>Then</h2>{block[1]}<h2>Links</h2>{links}</div></body>") == want.replace("second 0", "Then\nsecond 0")
    assert f(f"<body>{links}<div>{block[0]}</div><div><div>{block[1]}</div></div></body>") == want
    assert f(f"<body><div id=content>{block[0]}{block[1]}</div></body>") == want


def test_main_text():
    f = html_text.main_text
    assert f(None) == f("") == f("<html><body></body></html>") == f("<script>x") == ""
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a = "</p>";</script></head><body><header>Site</header><nav><ul><li><a href=x>Menu</a></li></ul></nav>
    <div class="cookie-notice">We use cookies</div><div id="wrap"><article><h1>A&amp;B &lt;c&gt;</h1><p><b>First   line
    here.<br><p>Second &eacute; &#233;.<ul><li>one<li>two</ul><aside>Related</aside><div class="ad">Buy</div><form><input value=x>Name</form><!-- no --></article>
    <section class="comments"><p>Great post, thanks a lot for this very long and winding comment about it all</p></section></div><footer>&copy; us</footer></body></html>"""
    assert f(page) == "A&B <c>\nFirst line here.\nSecond é é.\none\ntwo"
    assert f("<div><p>One two three four five six.</p><p>Seven eight nine.</p></div><div class=sidebar><p>no</p></div>") == "One two three four five six.\nSeven eight nine."
    assert f("<body><h1>Head</h1><div><p>One two three four.</p><p>Five six seven eight.</p></div></body>") == "Head\nOne two three four.\nFive six seven eight."
    assert f("<article><p>See <a href=x>all of this is one link</a></p><p><a href=y>a paragraph that is a link</a></p><p>x&am<b>p;</b></p></article>") == "See all of this is one link\na paragraph that is a link\nx&amp;"
    assert f("a < b and <") == "a < b and <" and f("<p>cut &am") == "cut &am"
    assert f("<div>" * 3000 + "deep") == "deep" and f("<a " * 20_000).startswith("<a")


def brute_core(root):
    """The core by its definition: every node's counts anew, from all that is below it."""
    import math

    def below(x):
        for y in x.parts:
            if isinstance(y, str):
                yield x, y
            elif not y.bad:
                yield x, y
                yield from below(y)

    def links_of(x):
        chars, tags = 0, 0
        for y in x.parts:
            if isinstance(y, html_text.Node) and not y.bad:
                c, t = links_of(y)
                chars, tags = chars + (count(y)[0] if y.name == "a" else c), tags + t + (y.name == "a")
        return (count(x)[0] if x.name == "a" else chars), tags

    def count(x):
        got = list(below(x))
        return sum(len(y.strip()) for _, y in got if isinstance(y, str)), sum(1 for _, y in got if not isinstance(y, str))

    nodes = [root] + [y for _, y in below(root) if not isinstance(y, str)]
    body = next((x for x in nodes if x.name == "body"), root)
    ratio = links_of(body)[0] / max(1, count(body)[0])

    def density(x):
        (c, t), (lc, lt) = count(x), links_of(x)
        if not c:
            return 0.0
        base = math.log(c / max(1, c - lc) * lc + ratio * c + math.e)
        return max(0.0, c / max(1, t) * math.log(max(1.0, c / max(1, lc) * max(1, t) / max(1, lt))) / math.log(base)) if base > 1 else c / max(1, t)

    def blocky(x):
        return x.name in html_text.BLOCK or any(blocky(y) for y in x.parts if isinstance(y, html_text.Node) and not y.bad)

    sums = [sum(density(y) for y in x.parts if isinstance(y, html_text.Node) and not y.bad and blocky(y)) for x in nodes]
    best = nodes[sums.index(max(sums))] if max(sums) else body
    path, up = [density(best)], best
    while up is not None and up is not body.parent:
        path.append(density(up))
        up = up.parent
    return best, min(path)


def test_density_against_brute_force():
    import random

    r = random.Random(8)

    def piece(depth):
        kind = r.choice(["p", "div", "a", "b", "ul", "li", "section", "span", "nav", "h2"])
        inner = "".join(r.choice(["some words ", "x ", "a longer run of words and more of them. "]) if r.random() < 0.5 or not depth else piece(depth - 1) for _ in range(r.randrange(4)))
        return f"<{kind}>{inner}" + (f"</{kind}>" if r.random() < 0.8 else "")

    for _ in range(120):
        root = html_text.parse("<body>" + "".join(piece(4) for _ in range(4)) + "</body>")
        want = brute_core(root)
        got = html_text.core(root)
        assert got[0] is want[0] and got[1] == pytest.approx(want[1])


def test_main_text_without_marks():
    import os

    import pyarrow.parquet as pq

    f, long = html_text.main_text, "words of the text " * 16
    sections = [f"<section><h2>Part {i}</h2><p>{long}{i}</p><p>{long}</p></section>" for i in range(2)]
    want = "\n".join(f"Part {i}\n{long}{i}\n{long.strip()}" for i in range(2))
    for tag in ("article", "main", "div"):
        assert f(f"<body><nav>menu</nav><{tag}>{''.join(sections)}</{tag}><footer>f</footer></body>") == f(f"<body><{tag}>{''.join(sections)}</{tag}></body>") == want
    assert f(f"<body>{''.join(sections)}</body>") == want
    assert f(f"<article><header><h1>Title</h1></header><div class=article-header>By line</div><p>{long}</p><label>kept</label></article><header>Site</header>") == f"Title\nBy line\n{long.strip()}\nkept"
    menu = "<div><ul>" + "<li><a href=x>link</a></li>" * 9 + "</ul></div>"
    assert f(f"<body>{menu}<div><p>{long}</p><p>{long}</p></div>{menu}</body>") == f"{long.strip()}\n{long.strip()}"
    assert f(f"<article><p>{long}</p>{menu}</article>").count("link") == 9  # a list of references of the article
    path = "/root/testdata/sf0.01/pages.parquet"
    for page in pq.read_table(path)["html"].to_pylist() if os.path.exists(path) else []:
        assert f(page) == f(re.sub(r"<(/?)(article|main)\b", r"<\1div", page or ""))


@pytest.mark.parametrize("page", ["<b>" * 9000 + "</i>" * 9000, "<i><div>" + "<b>" * 9000 + "</i>" * 9000, "<div>" + "<b>" * 9000 + "<p>x" * 9000, "<ul>" + "<li><ul>" * 9000 + "<li>x" * 9000])
def test_long_pages_in_linear_time(page):
    import time

    start = time.process_time()
    html_text.main_text(page)
    assert time.process_time() - start < 3


def test_html_table(spark):
    df = spark.createDataFrame([(1, "u", "<p>x", 1), (None, None, None, None), (1, "u", "<p>x", 2)], "page_id long, url string, html string, text int")
    assert Counter(tuple(r) for r in html_text.extract(df).collect()) == {(1, "u", "x"): 2, (None, None, ""): 1}
    assert html_text.extract(df.limit(0)).count() == 0


def brute_tiles(item, doc, least):
    """Greedy string tiling as published: the longest matches of unmarked tokens first."""
    a, b, out, least = [False] * len(item), [False] * len(doc), 0, min(least, len(item))
    while True:
        best = (0, 0, 0)
        for i in range(len(item)):
            for j in range(len(doc)):
                k = 0
                while i + k < len(item) and j + k < len(doc) and item[i + k] == doc[j + k] and not a[i + k] and not b[j + k]:
                    k += 1
                if k > best[0]:
                    best = (k, i, j)
        if best[0] < least or not least:
            return out
        k, i, j = best
        a[i : i + k] = [True] * k
        b[j : j + k] = [True] * k
        out += k


@pytest.mark.parametrize("block", [2_000_000, 30])
def test_tiling_against_brute_force(spark, make, prose, block):
    items = [prose(i, 25) for i in range(6)] + ["only three words", None, "", prose(0, 25)]
    words = [(t or "").lower() for t in items]
    parts = items[2].split()
    docs = [None, "", prose(90, 50), f"{prose(91, 20)} {items[0].upper()}!! {prose(92, 9)}", " ".join(parts[12:] + ["xx"] + parts[:12]), items[1].replace(" ", " | "), " ".join(items[3].split()[:10]), "x only THREE words y", items[4] + " " + items[4], prose(93, 4000)]
    bench = spark.createDataFrame([(i if i != 5 else None, t, 0) for i, t in enumerate(items)], "item_id long, text string, __hits int")
    got = decontaminate.overlaps(make(list(enumerate(docs))), bench, block=block)
    for r in got.collect():
        d = re.findall(r"\w+", (r.text or "").lower())
        want = {}
        for i, w in enumerate(words):
            t = re.findall(r"\w+", w)
            if len(d) < 500 and t and (n := brute_tiles(t, d, 5)):
                want[i if i != 5 else None] = n / len(t)
        if len(d) < 500:
            assert {h.item_id: h.coverage for h in r["__hits"]} == pytest.approx(want), r.doc_id
    kept = decontaminate.clean(make(list(enumerate(docs))), bench, block=block)
    ids = {r.doc_id for r in kept.collect()}
    assert ids >= {0, 1, 2, 6, 9} and not ids & {3, 4, 5, 7, 8} and kept.columns == make([]).columns
    assert decontaminate.overlaps(make([(1, "a")]), bench.limit(0)).first()["__hits"] == []
    named = make(list(enumerate(docs))).selectExpr("*", "1 AS hits_", "2 AS `__hits`", "3 AS id_", "4 AS th_", "5 AS got_")
    kept = decontaminate.clean(named, bench, block=block)
    assert {r.doc_id for r in kept.collect()} == ids and kept.columns == named.columns


def test_tiles_of_repeated_words(monkeypatch):
    import random

    import numpy as np

    r = random.Random(5)
    cases = [([r.randrange(k) for _ in range(r.randrange(1, 30))], [r.randrange(k) for _ in range(r.randrange(1, 40))], least) for k in (1, 2, 3) for least in (1, 2, 5) for _ in range(12)]
    for pairs in (decontaminate.PAIRS, 0):
        monkeypatch.setattr(decontaminate, "PAIRS", pairs)
        for item, doc, least in cases:
            assert sum(z for _, _, z in decontaminate.tiles(np.array(item), np.array(doc), least)) == brute_tiles(item, doc, least)
    monkeypatch.undo()
    assert decontaminate.tiles(np.zeros(3000, np.int64), np.zeros(3000, np.int64), 5) == [(0, 0, 3000)]


def test_seeds_that_all_items_hold(monkeypatch, prose):
    items = [(i, decontaminate.words(f"which of the following is true {prose(i, 9)}")) for i in range(30)]
    texts = [f"{prose(100 + i, 20)} which of the following is true {' '.join(items[i][1][3:])}" for i in range(8)] + [None, ""]
    whole = [sorted(x) for x in decontaminate.Block(items, 5).match(texts)]
    assert all(len(x) == 30 for x in whole[:8])
    for pairs in (40, 1):
        monkeypatch.setattr(decontaminate, "PAIRS", pairs)
        assert [sorted(x) for x in decontaminate.Block(items, 5).match(texts)] == whole


def test_marginals_against_enumeration():
    import itertools

    import numpy as np

    rng = np.random.default_rng(0)
    scores, step, begin = rng.normal(size=(7, 3)), rng.normal(size=(3, 3)), rng.normal(size=3)
    first = np.array([1, 0, 0, 1, 1, 0, 0], bool)
    want = np.zeros((7, 3))
    for y in itertools.product(range(3), repeat=7):
        s = sum(scores[i, y[i]] + (begin[y[i]] if first[i] else step[y[i - 1], y[i]]) for i in range(7))
        want[np.arange(7), y] += np.exp(s)
    want /= want.sum(axis=1, keepdims=True)
    assert np.allclose(language.marginals(scores, first, step, begin), want)


def test_gradients_against_differences():
    import itertools

    import numpy as np

    rng = np.random.default_rng(1)
    parts = [rng.normal(size=(6, 3)), rng.normal(size=(3, 3)), rng.normal(size=3)]
    first = np.array([1, 0, 0, 1, 0, 0], bool)

    def log_sum(scores, step, begin):
        return np.log(sum(np.exp(sum(scores[i, y[i]] + (begin[y[i]] if first[i] else step[y[i - 1], y[i]]) for i in range(6))) for y in itertools.product(range(3), repeat=6)))

    got = language.expected(parts[0], first, parts[1], parts[2])
    for x, g in zip(parts, got):
        for at in np.ndindex(x.shape):
            old, ends = x[at], []
            for d in (1e-5, -1e-5):
                x[at] = old + d
                ends.append(log_sum(*parts))
            x[at] = old
            assert abs((ends[0] - ends[1]) / 2e-5 - g[at]) < 1e-6


def test_learned_transitions():
    import numpy as np

    spans = [("ab"[i % 2], [f"{'ab'[i % 2]}{j}" for j in range(12)]) for i in range(200)]
    model = language.fit(spans)
    assert model.step[0, 0] > model.step[0, 1] and model.step[1, 1] > model.step[1, 0]
    begin = language.fit(spans + [("a", ["x"])] * 400).begin
    assert begin[0] > begin[1] and abs(begin.sum()) < 1e-9 and np.isfinite(begin).all()


def test_words():
    w = language.words
    assert w("One two2three") == ["one", "two", "three"] and w("½ ² Ⅷ 123 _") == [] and w(None) == w("") == []
    assert w("नमस्ते दुनिया") == ["नमस्ते", "दुनिया"] and w("e\u0301te\u0301 x½y") == ["e\u0301te\u0301", "x", "y"] and w("\u0301 été") == ["été"] and w("𐐀𐐁 漢字") == ["𐐨𐐩", "漢字"]


def test_language(spark, make):
    import random

    r = random.Random(3)
    vocab = {"en": "the of and thing with that from ing".split(), "de": "der die und ich nicht schön ung über".split(), "fr": "le la que été ç'est dans une très".split()}
    rows = [(i, " ".join(r.choice(vocab[k]) for _ in range(30)), k) for i, k in enumerate(r.choice(list(vocab)) for _ in range(240))]
    rows += [(900, None, "en"), (901, "", None), (902, "123 !!", "de"), (None, "the of and the thing", None), (903, "DER!! DIE!! UND!! | ICH", None), (905, "½ ² Ⅷ", "fr"), (904, "the " * 60_000, None)]
    docs = make(rows)
    model = language.train(docs)
    out = language.label(docs, model, ("lang_pred", "lang_score"))
    got = {x.doc_id: x for x in out.collect()}
    assert out.columns == [*docs.columns, "lang_pred", "lang_score"]
    assert sum(got[d].lang_pred == k for d, _, k in rows[:240]) >= 235
    assert all(got[d].lang_pred == "und" and got[d].lang_score == 0 for d in (900, 901, 902, 905)) and got[903].lang_pred == "de" and got[904].lang_pred == "en" and got[None].lang_pred == "en"
    assert all(0 <= x.lang_score <= 1 for x in got.values())
    assert {x.lang_pred for x in language.label(docs, language.train(docs.where("lang IS NULL")), ("lang_pred", "lang_score")).collect()} == {"und"}
    assert language.label(make([]), model, ("lang_pred", "lang_score")).count() == 0
    with pytest.raises(ValueError):
        language.label(docs, model)
    # code-switched words are told apart within one text
    text = "the of and thing with that der die und nicht schön über"
    ws = language.words(text)
    import numpy as np

    m = model.label(model.word_scores(ws).astype(float), np.arange(len(ws)) == 0)
    named = [model.labels[i] for i in m.argmax(axis=1)]
    assert named[:5] == ["en"] * 5 and named[-5:] == ["de"] * 5


def test_held_out(spark):
    import zlib

    ids = [0, 1, 17, -5, None]
    got = [r[0] for r in spark.createDataFrame([(i,) for i in ids], "doc_id long").select(language.held_out()).collect()]
    assert got == [i is not None and zlib.crc32(str(i).encode()) % 3 == 1 for i in ids]


def test_digest_of_no_spans():
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0")
