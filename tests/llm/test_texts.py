import itertools
import random
import unicodedata

import pytest
import regex

from lociflow.llm import bpe, repeats, winnow
from lociflow.llm.words import words

P = pytest.importorskip("public_tokenizers")
ODD = [
    None,
    "",
    " ",
    "\n\n \t",
    "a",
    "<|endoftext|> plain",
    "日本語の文章は空白がありません。" * 30,
    "Straße ﬁne Ⅳ ١٢٣ é",
    "x" * 5000,
    "ab" * 4000 + " tail",
    "😀😀 � \u0000 ​",
    "'s I'll don't  DON'T",
    "word " * 3000,
]


def brute_words(text):
    out, run = [], ""
    for c in unicodedata.normalize("NFKC", text or "").lower() + " ":
        if unicodedata.category(c)[0] in "LN":
            run += c
        elif run:
            out.append(run)
            run = ""
    return out


def test_words():
    for text in ODD:
        assert words(text) == brute_words(text)


def test_encoding_equals_the_library_and_decodes(spark):
    tokenizers = pytest.importorskip("tokenizers")
    library = tokenizers.Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    library.encode_special_tokens = True
    rng = random.Random(5)
    texts = ODD + ["".join(chr(rng.choice([rng.randint(32, 126), rng.randint(160, 0x2FFF)])) for _ in range(200)) for _ in range(100)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").selectExpr("*", "1 as ids", "2 as _key")
    said = dict(bpe.encode_texts(df, "doc_id", "text").collect())
    ranks = bpe.read_ranks(P.path("byte_bpe_50k.tiktoken"))
    back = {v: k for k, v in ranks.items()}
    for i, text in enumerate(texts):
        assert said[i] == (library.encode(text, add_special_tokens=False).ids if text else [])
        assert b"".join(back[x] for x in said[i]) == (text or "").encode()
    assert bpe.encode_texts(df.limit(0), "doc_id", "text").collect() == []


def test_short_and_long_words_merge_alike():
    ranks = bpe.read_ranks(P.path("byte_bpe_50k.tiktoken"))
    rng = random.Random(2)
    for _ in range(400):
        word = bytes(rng.choice(b"abcdetTHN\xc3\xa9") for _ in range(rng.randint(1, 60)))
        assert bpe.merge_short(word, ranks) == bpe.merge_long(word, ranks)


def corpus(seed=4):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(5, 40)))) for i in range(20)]
    docs = []
    for d in range(150):
        own = [rng.choice(vocabulary) for _ in range(rng.randint(0, 60))]
        source = rng.choice(items)[1].split()
        a = rng.randint(0, max(0, len(source) - 1))
        own[len(own) // 2 : len(own) // 2] = source[a : a + rng.randint(5, 14)]
        docs.append((d, ", ".join(own).upper()))
    docs += [(900, None), (901, ""), (902, docs[0][1]), (0, docs[0][1])]
    items += [(90, None), (91, ""), (92, items[0][1])]
    return docs, items


def test_winnowing_finds_every_shared_span(spark, rows, monkeypatch):
    docs, items = corpus()
    least = winnow.LEAST
    runs = lambda w: {tuple(w[i : i + least]) for i in range(len(w) - least + 1)}
    truth = sorted({(d, i) for d, t in docs for i, s in items if runs(brute_words(t)) & runs(brute_words(s))}, key=repr)
    a = spark.createDataFrame(docs, "doc_id bigint, text string").selectExpr("*", "7 as fingerprint", "8 as _item")
    b = spark.createDataFrame(items, "item_id bigint, text string").selectExpr("*", "7 as run", "8 as at")
    assert rows(winnow.holders(a, "doc_id", "text", b, "item_id", "text")) == truth and len(truth) > 20
    found = winnow.leaks(a, "doc_id", "text", b, "item_id", "text").collect()
    assert sorted(((r.doc_id, r.item_id) for r in found), key=repr) == truth
    texts, passages = {}, {i: brute_words(s) for i, s in items}
    for d, t in docs:
        texts.setdefault(d, []).append(brute_words(t))
    for r in found:
        spans = [s for w in texts[r.doc_id] for s in brute_spans(w, passages[r.item_id], least)]
        best = min((-n, x, y) for n, x, y in spans)
        assert (-r.longest, r.doc_from, r.item_from) == best and r.spans <= len(spans)
    monkeypatch.setattr(winnow, "MOST_BITS", 10)  # a full bitmap loses nothing
    assert rows(winnow.holders(a, "doc_id", "text", b, "item_id", "text")) == truth
    for x, y in ((a.limit(0), b), (a, b.limit(0))):
        assert rows(winnow.leaks(x, "doc_id", "text", y, "item_id", "text")) == [] == rows(winnow.holders(x, "doc_id", "text", y, "item_id", "text"))


def brute_spans(a, b, least):
    out = []
    for x in range(len(a)):
        for y in range(len(b)):
            if a[x] == b[y] and (x == 0 or y == 0 or a[x - 1] != b[y - 1]):
                n = 0
                while x + n < len(a) and y + n < len(b) and a[x + n] == b[y + n]:
                    n += 1
                if n >= least:
                    out.append((n, x, y))
    return out


def test_words_that_all_share_meet_in_no_join(spark):
    common = " ".join(f"c{i}" for i in range(8))  # below the least passage
    docs = spark.createDataFrame([(i, f"d{i} x{i} {common} y{i} z{i} v{i} u{i}") for i in range(300)], "doc_id bigint, text string")
    items = spark.createDataFrame([(i, f"i{i} j{i} {common} k{i} l{i} m{i} n{i}") for i in range(200)], "item_id bigint, text string")
    assert winnow.hits(docs, "doc_id", "text", items, "item_id", "text").count() == 0


def brute_share(text, size=4):
    w = brute_words(text)
    runs = [tuple(w[i : i + size]) for i in range(len(w) - size + 1)]
    return len(w), len(runs), len(set(runs))


def texts_with_repeats():
    rng = random.Random(8)
    out = list(ODD) + ["a b c d e f g. " * 3, "one two three four five six seven eight nine ten " * 2, "x y. x y. x y.", "l1\nl1\nl2\n\nl1\nl1"]
    for _ in range(120):
        base = [f"w{rng.randint(0, 30)}" for _ in range(rng.randint(0, 40))]
        out.append(" ".join(base + base[: rng.randint(0, len(base))] * rng.randint(0, 2)))
    return out


def test_ledger_against_brute_force(spark):
    texts = texts_with_repeats()
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").selectExpr("*", "1 as failed", "2 as n_words")
    book = repeats.ledger(df, "doc_id", "text").cache()
    for r in book.collect():
        n, runs, distinct = brute_share(texts[r.doc_id])
        assert (r.n_words, r.n_4grams, r.distinct_4grams) == (n, runs, distinct)
        expect = n >= 20 and (runs - distinct) * 10 >= 3 * runs
        assert bool(r.failed & 1) == expect, texts[r.doc_id]
        w = brute_words(texts[r.doc_id])
        for size in (5, 10):
            own = [tuple(w[i : i + size]) for i in range(len(w) - size + 1)]
            covered = {i + j for i, g in enumerate(own) if own.count(g) > 1 for j in range(size)} if len(w) < 500 else None
            if covered is not None:
                assert r[f"covered_{size}grams"] == pytest.approx(len(covered) / len(w) if w else 0)
        if len(w) < 500 and len(w) > 1:
            own = [tuple(w[i : i + 2]) for i in range(len(w) - 1)]
            top = max(own.count(g) for g in own)
            assert r.top_2gram == pytest.approx(min(1, (top if top > 1 else 0) * 2 / len(w)))
    effects = {(r.version, r.rule): r for r in repeats.policy_effects(book).collect()}
    ledger_rows = book.collect()
    for (version, rule), r in effects.items():
        mask, bit = repeats.policy_mask(version), 1 << repeats.RULES[rule][0]
        assert r.rejected == sum(bool(x.failed & mask) for x in ledger_rows)
        assert r.kept_without == sum(not x.failed & (mask & ~bit) for x in ledger_rows)
    assert repeats.ledger(df.limit(0), "doc_id", "text").collect() == []
    assert {r.rejected for r in repeats.policy_effects(book.limit(0)).collect()} == {0}


def test_pattern_is_the_public_one():
    assert bpe.public_pattern() == P.PATTERN and list(itertools.islice(regex.findall(P.PATTERN, "a b"), 2)) == ["a", " b"]
