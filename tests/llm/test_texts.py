"""HTML text, quality, secrets, packing, mixing, fingerprints and the pipeline."""

import base64
import bisect
import hashlib
import math
import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tesserine.llm import html_text, mixing, packing, quality_model, secret_forest, spot_signatures, tokens

from .helpers import empty, frame, texts, words

PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{}</style><script>var a="</p>";</script></head><body class="with-sidebar">
<header><h2>Site</h2></header><nav><ul><li><a href=/>Home</a><li><a href=/x>Other</a></ul></nav><div class="cookie-notice">We use cookies</div>
<article><h1>Title &amp; more</h1><p><b>First   line<br>goes &lt;on&gt;.<p>Second&nbsp;one.</p><div class=ad>Buy now</div><p>x</p>
<form><label>Mail</label><input name=q><button>Go</button></form><section id="comments"><p>Nice article</p></section></article>
<aside>Side</aside><footer>&copy; 2024</footer></body></html>"""


def test_html_article():
    assert html_text.main_text(PAGE) == "Title & more\n\nFirst line goes <on>.\n\nSecond one.\n\nx"


def test_html_without_article():
    long = "This is a sentence of some length that stands in the page's text, with commas and all. " * 3
    page = f"<body><ul><li><a href=/>Home</a></li><li><a href=/b>About us</a></li></ul><div><p>{long}</p><p>{long}</p></div><div class='sidebar'>{long}</div></body>"
    assert html_text.main_text(page) == "\n\n".join([long.strip()] * 2)


@pytest.mark.parametrize("page", [None, "", "   ", "<html></html>", "<![bad[ ", "<!", "<p", "</p></p></div>", "<a href='"])
def test_html_broken(page):
    assert isinstance(html_text.main_text(page), str)


@pytest.mark.parametrize("odd", ["<![foo bar]>", "<![ ]>", "<![1 2>", "<![>", "<![endif]-->", "<!-x>", "<!DOCTYPE [ <!x> ]>"])
def test_html_reads_on_behind_declarations(odd):
    text = html_text.main_text(f"<p>a first paragraph</p>{odd}<p>b second paragraph</p><p>c third paragraph</p>")
    assert text.startswith("a first paragraph") and text.endswith("b second paragraph\n\nc third paragraph")


@pytest.mark.parametrize(
    "page",
    [
        "<div class='content-sidebar-wrap'><nav>Menu</nav><main>{}</main><div class='sidebar'><p>Side</p></div></div>",
        "<div class='site has-sidebar'><article>{}</article><div id='comments'><article class='comment'><p>Nice</p></article></div></div>",
        "<main><div class='with-sidebar'><article>{}</article><div class='related'><article>Other</article></div></div></main>",
        "<body><form action='x'><div>{}</div></form></body>",
        "<article><form>{}</form></article>",
        "<body><div class='site has-sidebar'><div>{}</div><div class='sidebar'>Side</div></div></body>",
    ],
)
def test_html_furniture_words_do_not_hide_the_content(page):
    lines = [f"Sentence {k} of the page's text has some length, with commas and all." for k in range(5)]
    assert html_text.main_text(page.format("".join(f"<p>{x}</p>" for x in lines))) == "\n\n".join(lines)


def test_html_keeps_all_regions():
    body = "A long sentence of the page's text, with commas and all. " * 20
    assert html_text.main_text(f"<div class='entry'><p>A short lead.</p></div><div class='post'><p>{body}</p></div>") == f"A short lead.\n\n{body.strip()}"


def test_html_table(spark):
    df = spark.createDataFrame([(1, "u", PAGE, 7), (1, "u", PAGE, 7), (2, None, None, None), (None, "v", "<p>" + "a " * 50_000, 1)], "page_id long, url string, html string, n_chars int")
    rows = html_text.extract(df).collect()
    assert [(r.page_id, r.n_chars, len(r.text)) for r in rows] == [(1, 51, 51), (1, 51, 51), (2, 0, 0), (None, 99_999, 99_999)]
    assert html_text.extract(empty(df)).collect() == []


def rated(n=300, seed=2):
    r = random.Random(seed)
    good = "a river runs past the old town and people walk along its banks in summer".split()
    out = []
    for i in range(n):
        g = i % 3
        w = [r.choice(good) + str(r.randint(0, 5)) for _ in range(r.randint(20, 60))]
        if g == 0:
            w = [x + "%%%" for x in w]
        elif g == 1:
            w[r.randrange(len(w))] = "nasty"
            w[r.randrange(len(w))] = "nasty"
        out.append((i, " ".join(w), g))
    return out


def test_ordinal_model_held_out():
    rows = rated()
    split = lambda part: (quality_model.features(pa.array([t for _, t, _ in part])), np.array([g for *_, g in part]))
    (r, b), g = split(rows[:200])
    model = quality_model.fit(r, b, g)
    assert (np.diff(model.thresholds) >= 0).all()
    (r, b), g = split(rows[200:])
    tails = model.tails(model.scores(r, b, len(g)))
    assert (tails[:, 0] >= tails[:, 1]).all()
    assert ((tails >= 0.5).sum(1) == g).mean() > 0.9


def test_quality_edges(spark):
    docs = spark.createDataFrame([(i, t, "x") for i, t, _ in rated(90)] + [(900, None, "x"), (901, "", "x"), (None, "word", "x"), (5, "again", "y")], "doc_id long, text string, label string")
    labels = spark.createDataFrame([(i, int(g > 0), int(g == 1)) for i, _, g in rated(90)] + [(1, 0, 0), (None, 1, 1), (2, None, None), (7777, 1, 0)], "doc_id long, quality int, toxic int")
    out = quality_model.rated(docs, labels)
    assert out.count() == 94 and out.where("kept is null").count() == 0
    assert quality_model.rated(docs, empty(labels)).where("kept").count() == 94
    assert quality_model.rated(empty(docs), labels).collect() == []


def test_forest_held_out():
    x, y = secret_forest.findings(1500, 99)
    assert (((secret_forest.trained().score(x) >= 0.5) == y).mean()) > 0.97


def test_secrets_in_texts(spark):
    key = hashlib.sha1(b"k").hexdigest()
    rows = [
        (0, f'see token = "{key}" there', "src0"),
        (1, f"fixed in commit {key} yesterday", "src0"),
        (2, "order 4111111111111111 of 2024-05-06, uuid 123e4567-e89b-12d3-a456-426614174000", None),
        (3, None, "a"),
        (4, "", "a"),
        (5, "nothing here", "a"),
        (6, f'token = "{key}" ' * 500, "a"),
    ]
    df = spark.createDataFrame([(*r, "old") for r in rows], "doc_id long, text string, source string, findings string")
    got = {r.doc_id: r for r in secret_forest.scanned(df).collect()}
    assert [len(got[i].findings) for i in range(7)] == [1, 0, 0, 0, 0, 0, 500]
    assert got[0].clean_text == 'see token = "[SECRET]" there' and got[1].clean_text == rows[1][1]
    f = got[0].findings[0]
    assert rows[0][1][f.start : f.end] == key and got[3].clean_text is None
    assert secret_forest.scanned(empty(df)).collect() == []


BODY = "\n".join(base64.b64encode(hashlib.sha384(bytes([k])).digest()).decode() for k in range(4))


@pytest.mark.parametrize(
    "lead, secret, rest",
    [
        ('password = "', "Sommer2024!", '"'),
        ("passwd: ", "hunter2", " and more"),
        ('db_password="', "Tr0ub4dor&3x", '"'),
        ('api_key = "', "QwErTyUiOpAsDfGhJkLzXcVb", '"'),
        ("", f"-----BEGIN PGP PRIVATE KEY BLOCK-----\nVersion: x 1\n\n{BODY}\n=aBcD\n-----END PGP PRIVATE KEY BLOCK-----", " end"),
        ("", f"-----BEGIN RSA PRIVATE KEY-----\nProc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,0A1B\n\n{BODY}\n-----END RSA PRIVATE KEY-----", " end"),
        ("see ", f"-----BEGIN RSA PRIVATE KEY-----\n{BODY}\nabcd12", ""),
    ],
)
def test_secrets_of_all_kinds(lead, secret, rest):
    _, found = secret_forest.scan(lead + secret + rest)
    assert [(a, b) for a, b, _ in found] == [(len(lead), len(lead) + len(secret))]


def test_words_assigned_to_keys_are_judged():
    for text in ("password = required", "token: string", "the secret is keeping calm"):
        n, found = secret_forest.scan(text)
        assert n == 1 and found == []


PLAIN = """<body><div><a href=/a>Home</a></div><div><a href=/b>News</a></div><div><a href=/c>Sport</a> <a href=/d>More</a></div>
<div>{0}</div><div>{1}</div><div>Short.</div><div>{0}</div><div><a href=/e>Next</a></div><div><b>Tags</b> <i>x</i></div><div><a href=/f>Imprint</a></div></body>"""


def test_html_ratios_decide(monkeypatch):
    long = "A sentence of the article that is long enough to stand out from the rest of the page. " * 4
    page = PLAIN.format(long.strip(), long.strip() + " More.")
    want = "\n\n".join([long.strip(), long.strip() + " More.", "Short.", long.strip()])
    assert html_text.main_text(page) == want
    r = np.random.default_rng(1)
    monkeypatch.setattr(html_text, "smoothed", lambda ratios: r.random(len(ratios)))
    assert any(html_text.main_text(page) != want for _ in range(5))


def test_html_doubtful_names_and_regions():
    long = "A sentence that is long enough to stand out from the rest of the page, as articles have them. " * 3
    long = long.strip()
    for name in ("life-form", "legal-analysis", "share-price", "related-work"):
        page = f"<article><p>{long}</p><div class={name}><p>{long}</p><p>{long}</p></div><p>{long}</p></article>"
        assert html_text.main_text(page) == "\n\n".join([long] * 4)
        page = f"<article><p>{long}</p><p>{long}</p><div class={name}><a href=x>a</a> <a href=y>b</a> c</div><p>{long}</p></article>"
        assert html_text.main_text(page) == "\n\n".join([long] * 3)
    for name in ("ad", "user-comments", "cookie-notice", "site-footer", "newsletter"):
        assert html_text.main_text(f"<article><p>{long}</p><p>{long}</p><div class={name}><p>{long}</p></div></article>") == "\n\n".join([long] * 2)
    short = f"<div class=post><p>Read on.</p></div><div><p>{long}</p><p>{long}</p><p>{long}</p></div>"
    assert long in html_text.main_text(short)


def test_common_words_in_a_row_open_chains(spark):
    rows = [(0, "as it is in the red house"), (1, "the red house"), (2, "the " * 30_000 + "red house")]
    got = [r.s for r in spark.createDataFrame(rows, "doc_id long, text string").select("doc_id", spot_signatures.spots(F.col("text")).alias("s")).orderBy("doc_id").collect()]
    assert got[0] == got[1] == got[2] and len(got[0]) == 1


@pytest.mark.parametrize("special", [True, False])
def test_tokens_match_the_library(special):
    from tokenizers import Tokenizer

    path = tokens.vocabulary_path()
    library = Tokenizer.from_file(path)
    if not special:
        library.encode_special_tokens = True
    r = random.Random(1)
    letters = list(" \n\t  ''''stmdrevl''  aéß中9٣½!?.,-_  ́😀AB's 'll I'm \r\n<|endoftext|>")
    some = ["".join(r.choice(letters) for _ in range(r.randint(0, 40))) for _ in range(2000)] + [t or "" for t in texts()]
    some += ["<|endoftext|>", "a <|endoftext|> b", "a<|endoftext|><|endoftext|>\n", "<|endoftext", "<|ENDOFTEXT|>"]
    assert [x.tolist() for x in tokens.word_tokenizer(path, special).encode(some)] == [e.ids for e in library.encode_batch(some, add_special_tokens=False)]


def test_packing_round_trip(spark):
    df = frame(spark)
    df = df.union(df.limit(9))
    got = packing.pack(df, capacity=128).collect()
    encoder = tokens.word_tokenizer(tokens.vocabulary_path())
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in got:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append((r.offset, r.length))
    for doc_id, count, text in df.groupBy("doc_id", "text").count().select("doc_id", "count", "text").collect():
        ids = np.append(encoder.encode([text or ""])[0], np.uint32(0)).astype("<u4")
        want = [(k, s, n, zlib.crc32(ids[s : s + n].tobytes())) for k, (s, n) in enumerate(packing.cuts(len(ids), 128))] * count
        assert sorted((r.piece, r.start, r.length, r.ids_crc32) for r in by_doc[doc_id]) == sorted(want)
    for runs in by_sequence.values():
        at = 0
        for offset, length in sorted(runs):
            assert offset == at
            at += length
        assert at <= 128
    total = sum(r.length for r in got)
    assert len(by_sequence) <= math.ceil(total / 128) * 1.1 + 1
    assert packing.pack(empty(df)).collect() == []


def test_plan_places_every_rank_once():
    r = random.Random(3)
    counts = {s: r.randint(1, 50) for s in r.sample(range(1, 200), 80)}
    placed, opened = packing.plan(counts, 200)
    for size, n in counts.items():
        ranks = [k for s, first, m, _, _ in placed if s == size for k in range(first, first + m)]
        assert sorted(ranks) == list(range(n))
    assert opened >= sum(s * n for s, n in counts.items()) / 200


def test_mixing_budget_and_weights(spark):
    r = random.Random(4)
    rows = [(i, " ".join(["w"] * r.randint(0, 30)) if i % 17 else None, ["big"] * 6 + ["mid", "mid", None, "few"], "x") for i in range(600)]
    rows = [(i, t, s[i % 10] if i % 40 != 9 else "few", x) for i, t, s, x in rows]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, epoch string").drop("epoch")
    got = mixing.mixed(df, repeats=2.0, block=16).collect()
    tokens_of, taken = defaultdict(int), defaultdict(int)
    for _, t, s, _ in rows:
        tokens_of[s] += len(words(t))
    seen = defaultdict(set)
    for g in got:
        taken[g.source] += g.n_tokens
        assert g.epoch not in seen[g.doc_id]
        seen[g.doc_id].add(g.epoch)
    assert set(seen) == {i for i, *_ in rows}
    mix = mixing.solve({str(k): v for k, v in tokens_of.items()})
    for s, n in tokens_of.items():
        want = mix.epochs[str(s)] * n
        assert want - 1e-6 <= taken[s] <= want + 31
    rates = [taken[s] / n for s, n in tokens_of.items()]
    assert max(rates) / min(rates) <= 2.0 + 0.2 and max(rates) > 1.5
    assert mixing.mixed(empty(df)).collect() == []


def test_columns_of_the_operators_names(spark):
    names = ["_key", "_id", "_block", "_rank", "_times", "_whole", "_rest", "n_tokens", "epoch", "place", "expected_grade", "tail_probability", "kept", "n_candidates", "findings", "clean_text", "row", "a.b"]
    df = spark.createDataFrame([(i, f"some text {i}", "s" if i % 3 else None, *([f"own{i}"] * len(names))) for i in (0, 1, 2, 2)], "doc_id long, text string, source string, " + ", ".join(f"`{c}` string" for c in names))
    labels = spark.createDataFrame([(0, 1, 0), (1, 0, 0)], "doc_id long, quality int, toxic int")
    for out, own in (
        (mixing.mixed(df), {"n_tokens", "epoch", "place"}),
        (quality_model.rated(df, labels), {"expected_grade", "tail_probability", "kept"}),
        (secret_forest.scanned(df), {"n_candidates", "findings", "clean_text"}),
    ):
        rows = out.collect()
        assert sorted(out.columns) == sorted(df.columns) and {r.doc_id for r in rows} == {0, 1, 2}
        assert all(r[c] == f"own{r.doc_id}" for r in rows for c in names if c not in own)


def test_mixing_of_many_sources_follows_the_plan(spark):
    r = random.Random(6)
    rows = [(i, " ".join(["w"] * r.randint(1, 9)), f"s{int(r.random() ** 3 * 40)}") for i in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    tokens_of = defaultdict(int)
    for _, t, s in rows:
        tokens_of[s] += len(words(t))
    shares = [n / sum(tokens_of.values()) for n in tokens_of.values()]
    for options in ({}, {"repeats": 1.3}, {"target_entropy": (mixing.entropy(shares) + math.log(len(shares))) / 2}, {"repeats": None}, {"budget": 2000.0}):
        mix, taken, seen = mixing.solve(tokens_of, **options), defaultdict(int), defaultdict(list)
        for g in mixing.mixed(df, block=8, **options).collect():
            taken[g.source] += g.n_tokens
            seen[g.source, g.epoch].append(g.place)
        for s, n in tokens_of.items():
            assert mix.epochs[s] * n - 1e-3 <= taken[s] <= mix.epochs[s] * n + 9
        assert all(len(set(x)) == len(x) for x in seen.values())


def plain_best_fit(sizes, capacity):
    """Each piece, from the longest on, to the smallest gap that holds it."""
    gaps = []
    opened = 0
    for n in sorted(sizes, reverse=True):
        at = bisect.bisect_left(gaps, n)
        if at == len(gaps):
            opened += 1
            gap = capacity
        else:
            gap = gaps.pop(at)
        bisect.insort(gaps, gap - n)
    return opened


def test_packing_is_as_tight_as_plain_best_fit(spark):
    r = random.Random(5)
    some = [" ".join(f"{r.choice('abcdefgh')}{k}" for k in range(int(r.random() ** 2 * 90))) for _ in range(400)]
    got = packing.pack(frame(spark, some), capacity=128).collect()
    assert len({x.sequence_id for x in got}) <= plain_best_fit([x.length for x in got], 128)


def test_mixing_targets():
    tokens_of = {"a": 1000, "b": 100, "c": 10, "d": 0}
    for target in (0.6, 0.9, 1.05):
        mix = mixing.solve(tokens_of, target_entropy=target)
        assert abs(mixing.entropy(list(mix.weights.values())) - target) < 1e-6
    assert mixing.solve({}).epochs == {} and mixing.solve({"d": 0}).epochs == {"d": 1.0}


def test_fingerprints_of_edited_texts(spark):
    df = frame(spark)
    rows = sorted((r.doc_id, r.text or "") for r in df.collect())
    got = {r.doc_id: r for r in spot_signatures.fingerprints(df, rows=7).collect()}
    prints = defaultdict(set)
    for k, (i, text) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1]
        cut = len(text) // 4
        edited = text[: len(text) - cut] + after[:cut]
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        prints[text].add(r.fingerprint)
        if edited == text:
            assert r.near_edited == 1.0 and r.edited_fingerprint == r.fingerprint
    assert all(len(x) == 1 for x in prints.values())
    assert spot_signatures.fingerprints(empty(df)).collect() == []


def test_fingerprints_of_one_row(spark):
    df = spark.createDataFrame([(None, "the quick fox of old and the lazy dog", "z")], "doc_id long, text string, sketch string")
    r = spot_signatures.fingerprints(df).head()
    assert r.near_next == 1.0 and 0 < r.near_edited <= 1.0


def test_near_pairs_match_plain(spark):
    df = frame(spark).where("text is not null")
    sets = {}
    for r in df.select("doc_id", spot_signatures.spots(F.col("text")).alias("s")).collect():
        if r.s and tuple(r.s) not in sets.values():
            sets[r.doc_id] = tuple(r.s)
    near = lambda x, y: len(set(x) & set(y)) / len(set(x) | set(y))
    want = {(a, b) for a in sets for b in sets if a < b and near(sets[a], sets[b]) >= 0.7}
    assert {(r.a, r.b) for r in spot_signatures.near_pairs(df, 0.7).collect()} == want


def test_large_signature_sets_are_compared_whole(spark):
    text = lambda k, more="": " ".join(f"the word{i} after{i}" for i in range(k)) + more
    sizes = [200, 250, 300, 345]
    df = spark.createDataFrame([(i, text(n)) for i, n in enumerate(sizes)] + [(4, text(345, " the last two"))], "doc_id long, text string")
    got = spot_signatures.fingerprints(df).orderBy("doc_id").collect()
    assert [r.near_next for r in got] == [200 / 250, 250 / 300, 300 / 345, 345 / 346, 200 / 346]
    assert len({r.fingerprint for r in got}) == 5
    want = {(a, b) for a, x in enumerate([*sizes, 346]) for b, y in enumerate([*sizes, 346]) if a < b and x / y >= 0.8}
    assert {(r.a, r.b) for r in spot_signatures.near_pairs(df, 0.8).collect()} == want
