"""Spelling variants, token alignment and language ID against brute force."""
import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from chainlens.llm import language_id, queries, spelling_variants, token_alignment

SF = "/root/testdata/sf0.001"
LOWER = {c: c + 32 for c in range(65, 91)}


# ------------------------------------------------------------ spelling variants

def brute_variants(rows, typo_every=97):
    n = Counter()
    for d, t in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = w.translate(LOWER)
            h = zlib.crc32(f"{'' if d is None else d}:{w}".encode())
            if h % typo_every == 0:
                w = w[:h % len(w)] + w[h % len(w) + 1:]
            n[w] += 1
    n = {w: c for w, c in n.items() if len(w) >= 5 and c >= 3}
    masked, shorter = defaultdict(set), defaultdict(set)
    for w in n:
        for i in range(len(w)):
            masked[w[:i], w[i + 1:]].add(w)
            shorter[w[:i] + w[i + 1:]].add(w)
    near = defaultdict(set)
    for group in masked.values():
        for w in group:
            near[w] |= group - {w}
    for w, longer in shorter.items():
        if w in n:
            for v in longer:
                near[w].add(v)
                near[v].add(w)
    form = {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return sorted(out)


def test_spelling_variants(spark, nasty, empty, docs):
    chains = [(i, " ".join(["kitten"] * 9 + ["kittan"] * 4 + ["kittaan"] + ["Kittens"] * 3 + ["Études", "études", "mitten"] * 3 + ["a" * 300] * 2), None, None,
               None, None, None, None, None, None, None) for i in range(3)]
    chained = spark.createDataFrame(chains, nasty.schema)
    for rows in (docs, nasty.unionByName(chained), chained):
        got = [tuple(r) for r in spelling_variants.variants(rows, typo_every=97).collect()]
        assert sorted(got) == brute_variants([(r.doc_id, r.text) for r in rows.collect()])
    assert {r.word: r.root for r in spelling_variants.variants(chained).collect()}["kittaan"] == "kitten"
    assert spelling_variants.variants(empty).count() == 0


def test_spelling_query_is_the_operator(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").collect()
    got = queries.op11_spelling_variants(spark, SF)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert sorted(tuple(r) for r in got.collect()) == brute_variants([(r.doc_id, r.text) for r in rows])


def test_shifted_checksums():
    prefixes = [b"", b"1:", b"12345:"]
    table = spelling_variants.shifted(np.array([zlib.crc32(p) for p in prefixes], np.uint32), 20)
    for p, row in zip(prefixes, table):
        for text in (b"", b"a", b"letters", b"\xc3\xa9" * 10):
            assert int(row[len(text)]) ^ zlib.crc32(text) == zlib.crc32(p + text)


def test_hot_word_is_one_row(spark):
    """A word that fills a third of all text, and hundreds of its variants."""
    letters = "abcdefghijklmnopqrstuvwxyz"
    others = [w for i in range(5) for c in letters for w in [("hello"[:i] + c + "hello"[i + 1:] + " ") * 3]]
    rows = spark.createDataFrame([(1, "hello " * 3000), (2, "".join(others))], "doc_id long, text string")
    got = {r.word: r for r in spelling_variants.variants(rows).collect()}
    assert got["hello"].n_near == 125 and all(r.root == "hello" for r in got.values())


# ------------------------------------------------------------ token alignment

BYTE, PIECE = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")


def brute_alignment(rows):
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer
    a, b = Tokenizer.from_file(BYTE), SentencePieceProcessor(model_file=PIECE)
    a.encode_special_tokens = True
    own = [x for x in range(256) if 33 <= x <= 126 or 161 <= x <= 172 or x >= 174]
    back = {chr(x): x for x in own} | {chr(256 + i): x for i, x in enumerate(x for x in range(256) if x not in own)}

    def bytes_a(i):
        return bytes(back[c] for c in a.id_to_token(i))

    def bytes_b(i):
        p = b.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode()

    docs, held = [], Counter()
    for d, t in rows:
        x = a.encode(" " + t, add_special_tokens=False).ids if t else []
        y = b.encode(t) if t else []
        want = (" " + t).encode() if t else b""
        if b"".join(map(bytes_a, x)) != want or b"".join(map(bytes_b, y)) != want:
            x, y = [], []
        spans = []
        for ids, size in ((x, bytes_a), (y, bytes_b)):
            at, out = 0, []
            for i in ids:
                out.append((at, at + len(size(i)), i))
                at = out[-1][1]
            spans.append(out)
        links = [(i, j) for s, e, i in spans[0] for u, v, j in spans[1] if s < v and u < e]
        ends = sorted({e for _, e, _ in spans[0]} & {e for _, e, _ in spans[1]})
        groups, last = [], 0
        for e in ends:
            groups.append("|".join(",".join(str(i) for s, f, i in side if last <= s and f <= e) for side in spans))
            last = e
        docs.append((d, len(x), len(y), links, groups))
        held.update(set(links))
    best = {}
    for (i, _), c in held.items():
        best[i] = max(best.get(i, 0), c)
    return sorted(((d, na, nb, len(g), len(links), sum(held[p] == best[p[0]] for p in links), sum(held[p] for p in links),
                    hashlib.sha256(";".join(g).encode()).hexdigest() if na else "") for d, na, nb, links, g in docs), key=str)


ODD_TEXTS = ["", None, " ", "\n", "a  b", "a\nb", "\nlead", " lead", "tail ", "two\n\nfeeds", "sp \nfeed", "tab\tx \t y", "▁bar", "x▁y", "ﬁ   nbsp",
             "<|endoftext|> <s> </s> <unk> <0x0A>", "\U0001F600漢字 é", "don't we'll 12345 ...", "\r\n win", "a\x00b"]


@pytest.mark.parametrize("head", [0, 50, 150_000])
def test_token_alignment(spark, nasty, empty, head):
    odd = spark.createDataFrame([(i, t) for i, t in enumerate(ODD_TEXTS)], "doc_id long, text string")
    short = nasty.select("doc_id", "text").filter("text is null or length(text) < 3000")
    both = odd.unionByName(short).repartition(3)
    got = [tuple(r) for r in token_alignment.align(both, BYTE, PIECE, head=head).collect()]
    assert sorted(got, key=str) == brute_alignment([(r.doc_id, r.text) for r in both.collect()])
    assert token_alignment.align(empty, BYTE, PIECE, head=head).count() == 0


def test_token_alignment_of_documents(spark, docs):
    few = [(r.doc_id, r.text) for r in docs.collect() if r.text is None or len(r.text) < 1500]
    rows = spark.createDataFrame(few, "doc_id long, text string")
    got = [tuple(r) for r in token_alignment.align(rows, BYTE, PIECE).collect()]
    assert sorted(got, key=str) == brute_alignment(few)


def test_very_long_text_is_aligned_whole(spark, nasty):
    r = token_alignment.align(nasty.filter("doc_id in (503, 504)"), BYTE, PIECE).orderBy("doc_id").collect()
    assert r[1].n_groups == 30_001 and r[0].n_a > 1000 and r[0].n_links >= r[0].n_a


def test_pointer_doubling_labels_components():
    rng = np.random.default_rng(0)
    for _ in range(50):
        ends = [np.unique(np.append(rng.integers(1, 200, rng.integers(1, 60)), 200)) for _ in range(2)]
        _, _, group_a, group_b = token_alignment.components(*ends)
        common = np.intersect1d(*ends)
        for e, g in zip(ends, (group_a, group_b)):
            want = np.searchsorted(common, e, "left")
            assert (np.unique(g, return_inverse=True)[1] == want).all()


# ------------------------------------------------------------ language ID

def brute_kneser_ney(words, alphabet, order):
    """P(char | context) by the definition, with dictionaries."""
    raw = Counter()
    for w, n in words.items():
        s = "\0" * (order - 1) + w + "\x01"
        for i in range(order - 1, len(s)):
            raw[s[i - order + 1:i + 1]] += n
    counts = {order: dict(raw)}
    for k in range(order - 1, 0, -1):
        seen, total = defaultdict(set), Counter()
        for g in {g[-k - 1:] for g in raw}:
            seen[g[1:]].add(g[0])
        for g, n in raw.items():
            total[g[-k:]] += n
        counts[k] = {g: total[g] if g[0] == "\0" else len(v) for g, v in seen.items()}

    def p(gram):
        k = len(gram)
        if k == 0:
            return 1 / (alphabet + 1)
        own = counts[k]
        once, twice = (sum(c == x for c in own.values()) for x in (1, 2))
        discount = once / (once + 2 * twice) if once else 0.5
        follow = {g: c for g, c in own.items() if g[:-1] == gram[:-1]}
        if not follow:
            return p(gram[1:])
        total = sum(follow.values())
        return (max(follow[gram] - discount, 0) if gram in follow else 0) / total + discount * len(follow) / total * p(gram[1:])
    return p


def test_kneser_ney_is_its_definition():
    words = Counter({"banana": 3, "band": 2, "bandana": 1, "an": 7, "nab": 1, "dab": 1, "été": 2})
    keys, starts = language_id.grams(list(words))
    per_key = np.repeat(list(words.values()), np.diff(starts, append=len(keys)))
    only, place = np.unique(keys, return_inverse=True)
    alphabet = len(np.unique(only & language_id.mask(1)))
    model = language_id.Model(only, np.bincount(place, per_key), alphabet)
    p = brute_kneser_ney(words, alphabet, language_id.ORDER)
    for w in [*words, "bab", "zebra", "nanana", "x"]:
        keys, _ = language_id.grams([w])
        s = "\0" * 4 + w + "\x01"
        assert np.allclose(model.probability(keys), [p(s[i:i + 5]) for i in range(len(w) + 1)])
    # the characters' probabilities after a context sum to one, the unknown character's share included
    chars = np.unique(only & language_id.mask(1))
    for context in (0, int(keys[0]), int(only[7])):
        base = (context << language_id.BITS) & language_id.mask(language_id.ORDER)
        total = model.probability(base | chars).sum() + model.probability(np.array([base | 4095]))[0]
        assert abs(total - 1) < 1e-9


def test_language_id_on_documents(spark, docs):
    got = queries.op13_language_id(spark, "/root/testdata/sf0.01").collect()
    rows = {r.doc_id: r for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    tested = [r for r in got if r.held_out]
    right = [r.lang_pred == rows[r.doc_id].lang for r in tested]
    assert np.mean(right) >= 0.97
    assert np.mean([r.accepted for r in tested]) >= 0.95
    by_score = sorted(tested, key=lambda r: r.score)
    assert np.mean([r.lang_pred == rows[r.doc_id].lang for r in by_score[len(by_score) // 10:]]) >= np.mean(right)


def test_language_id_rejects_and_defines_every_case(spark, nasty, empty, docs):
    rows = docs.filter("doc_id % 5 <> 0")
    model = language_id.learn(rows)
    odd = [(1, None), (2, ""), (3, "123 --- \n 45"), (4, "привет как дела сегодня " * 5),
           (5, "xqzjkvw " * 40), (None, "the and of"), (6, "w" * 100_000)]
    got = {r.doc_id: r for r in language_id.identify(spark.createDataFrame(odd, "doc_id long, text string"), model).collect()}
    for k in (1, 2, 3):
        assert (got[k].lang_pred, got[k].score, got[k].accepted) == ("und", 0.0, False)
    assert not got[4].accepted and not got[5].accepted and got[4].lang_pred in model.langs
    assert got[None].lang_pred == "en" and 0 <= got[6].score <= 1
    assert language_id.identify(nasty, model).count() == nasty.count()
    assert language_id.identify(empty, model).count() == 0
    none = language_id.learn(empty)
    assert {(r.lang_pred, r.score, r.accepted) for r in language_id.identify(nasty, none).collect()} == {("und", 0.0, False)}
    only = language_id.learn(nasty)  # one language, and nulls among the labels
    assert only.langs == ["en"] and language_id.identify(nasty, only).filter("lang_pred = 'en'").count() > 100


def test_learning_is_the_definition_over_the_sample(spark, docs):
    """The distributed counts give the models that counting in one place gives."""
    model = language_id.learn(docs, max_rows=10_000)  # every row
    counts = defaultdict(Counter)
    for r in docs.collect():
        counts[r.lang].update(language_id.words_of(r.text or ""))
    alphabet = len({c for n in counts.values() for w in n for c in w}) + 1
    text = "The onnt the enedou que la einheit élève"
    words = language_id.words_of(text)
    n, ce = language_id.entropies(model.models, [text])
    assert n[0] == sum(len(w) + 1 for w in words)
    for k, lang in enumerate(model.langs):
        p = brute_kneser_ney(counts[lang], alphabet, 5)
        want = -sum(np.log(p(("\0" * 4 + w + "\x01")[i:i + 5])) for w in words for i in range(len(w) + 1)) / n[0]
        assert abs(ce[0, k] - want) < 1e-9


def test_extra_columns_play_no_part(nasty):
    a = token_alignment.align(nasty.withColumn("pairs", F.lit("x")).withColumn("n", F.lit(1)), BYTE, PIECE)
    b = spelling_variants.variants(nasty.withColumn("word", F.lit("x")).withColumn("a_n", F.lit(1)))
    assert a.count() == nasty.count() and "word" in b.columns
