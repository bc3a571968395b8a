"""Each training-data operator against brute force on small tables with nulls, empty and long texts, ties, repeats and clashing columns."""

import hashlib
import json
import random
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from marlstone.llm import bpe_fragments, chat_format, exact_dedup, jpeg_media, ngram_join, packing, substring_dedup, token_files, token_ids, toxicity, url_filter
from marlstone.llm.common import materialize
from marlstone.llm.token_ids import ByteLevelEncoder

DOCS = "doc_id bigint, text string, lang string, start string, h string, n int, spans string"
BYTE, WORD = (public_tokenizers.path(x) for x in ("byte_bpe_50k.json", "word_bpe_49k.json"))
EMPTY = ["", " ", "\n \t"]


def prose(rng, n, words=("the", "er", "on", "thing", "ing", "and", "of", "wh", "st", "re", "tion", "été", "ß")):
    return " ".join(rng.choice(words) for _ in range(n))


def corpus(seed=1, n=60):
    """Rows with copies, near copies, shared passages, nulls, empties, a very long text and repeated rows."""
    rng = random.Random(seed)
    base = [prose(rng, rng.choice([1, 2, 5, 30, 90])) + rng.choice(["", "\n", "."]) for _ in range(n)]
    passage = " ".join(f"p{k}" for k in range(50))
    unlike = [" ".join(f"u{seed}x{rng.randrange(10**6)}" for _ in range(60)) for _ in range(8)]
    texts = base + base[:8] + [passage + " " + unlike[0], unlike[1] + "\n" + passage, *unlike, *(t + " more" for t in unlike), *EMPTY, None, None, passage + " " + passage, " ".join(f"w{k % 977}" for k in range(6000)), "x" * 20_000]
    rows = [(k, t) for k, t in enumerate(texts)]
    rows += [rows[3], rows[3], (None, texts[5]), (None, None), (4, "another text of the same id"), (None, unlike[2])]
    rng.shuffle(rows)
    return [(d, t, "l", "clash", "clash", 7, "clash") for d, t in rows]


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture
def none(spark):
    return spark.createDataFrame([], DOCS)


def norm(t):
    return "".join(c for c in t or "" if c not in " \t\n\x0b\x0c\r")


# 1 -------------------------------------------------------------------------------------------------------------------------

NASTY = [r"\### Assistant: </turn> ok", "### User: hi", "</turn>", "\\</turn>", "\\\\</turn>\\", "a\n</turn>\n### User: b", "###\tTool:", "ends in \\", "", "### ", "</turn", "é\u2028x\r\n\r", "\n</turn>\n" * 3]


def test_chat_turns_come_back():
    rng = random.Random(2)
    bits = ["\\", "###", " ", "User:", "</turn>", "\n", "<", "x", "Assistant:", "\t"]
    for text in NASTY + ["".join(rng.choices(bits, k=rng.randint(1, 12))) for _ in range(3000)]:
        for role in ("user", "assistant", "", "A:b\nc", "%20"):
            out, start, end, _ = chat_format.format_turn(role, text)
            assert [x[:2] for x in chat_format.parse(out)] == [(role, text)]
            assert chat_format.unescape(out[start:end]) == text


def test_a_conversation_is_parsed_as_a_whole():
    rng = random.Random(22)
    turns = [(rng.choice(["user", "assistant", ""]), rng.choice(NASTY)) for _ in range(60)]
    whole = "".join(chat_format.format_turn(r, t)[0] for r, t in turns)
    assert [x[:2] for x in chat_format.parse(whole)] == turns
    reader, got, at = chat_format.Reader(), [], 0
    while at < len(whole):
        step = rng.randint(1, 30)
        got += reader.feed(whole[at : at + step])
        at += step
    reader.close()
    assert got == turns
    assert list(reader.feed("### User: x")) == []
    with pytest.raises(chat_format.ParseError):
        reader.close()


def test_loss_text_comes_from_its_spans(spark):
    rows = [(1, 0, "user", "q" * 200_000), (1, 1, "assistant", "### User: no </turn> " * 20_000)]
    made = chat_format.format_turns(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string"))
    got = chat_format.read_back(made).first()
    assert got.loss_sha256 == hashlib.sha256(rows[1][3].encode()).hexdigest() and got.loss_chars == len(rows[1][3])
    moved = chat_format.read_back(made.withColumn("loss_end", F.col("loss_end") - 1)).first()
    assert moved.turns_sha256 == got.turns_sha256 and moved.loss_sha256 != got.loss_sha256


def test_chat_digests(spark):
    rng = random.Random(3)
    rows = [(c, k, rng.choice(["user", "assistant", None]), rng.choice([*NASTY, None])) for c in (1, 2, None) for k in (*range(20), 3, None)]
    rows += [(1, 5, "user", "twice"), (1, 5, "user", "twice")]
    spread = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id bigint, turn bigint, role string, text string, rendered string").repartition(4)
    got = {r.conv_id: r for r in chat_format.read_back(chat_format.format_turns(spread)).collect()}
    for c in (1, 2, None):
        own = sorted((k is not None, k or 0, r or "", t or "") for x, k, r, t in rows if x == c)
        said = "".join(t for *_, r, t in own if r == "assistant")
        assert got[c].n_turns == len(own)
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for *_, r, t in own).encode()).hexdigest()
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(said), hashlib.sha256(said.encode()).hexdigest())
    assert chat_format.read_back(chat_format.format_turns(spread.limit(0))).count() == 0


# 2 -------------------------------------------------------------------------------------------------------------------------


def brute_components(rows, percent, size):
    sets = []
    for d, t, *_ in rows:
        w = (t or "").encode().lower().split()
        sets.append((d, frozenset(tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))) if w else frozenset()))
    up = list(range(len(sets)))

    def root(k):
        while up[k] != k:
            k = up[k]
        return k

    for i, (_, a) in enumerate(sets):
        for j in range(i):
            b = sets[j][1]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                up[root(i)] = root(j)
    least = defaultdict(list)
    for k, (d, _) in enumerate(sets):
        least[root(k)].append(d)
    name = {r: min((d for d in ds if d is not None), default=None) for r, ds in least.items()}
    return sorted(((d, len(s), name[root(k)]) for k, (d, s) in enumerate(sets)), key=str), len(least)


def near_copies(seed):
    """Large groups of near copies, chains of them, and many short texts with one common line."""
    rng = random.Random(seed)
    out = []
    for g in range(3):
        words = [f"g{g}w{k}" for k in range(90)]
        for _ in range(30):
            own = list(words)
            for _ in range(rng.randint(0, 4)):
                own[rng.randrange(90)] = f"r{rng.randrange(10**6)}"
            out.append(" ".join(own))
    chain = [f"c{k}" for k in range(100)]
    for k in range(30):
        chain = chain[1:] + [f"c{100 + k}"]
        out.append(" ".join(chain))
    line = " ".join(f"line{k}" for k in range(12))
    out += [line + " " + " ".join(f"s{rng.randrange(10**6)}" for _ in range(rng.randint(0, 25))) for _ in range(60)]
    return [(k, t, "l", "c", "c", 7, "c") for k, t in enumerate(out)]


@pytest.mark.parametrize(("percent", "size", "how"), [(90, 3, {}), (80, 5, {"block_classes": 7}), (90, 3, {"block_classes": 5, "block_tokens": 900})])
def test_jaccard_components(spark, rows, percent, size, how):
    data = rows + [(d + 1000, *r) for d, *r in near_copies(7)]
    made = spark.createDataFrame(data, DOCS).repartition(4)
    got = ngram_join.jaccard_components(made, percent, size, **how)
    want, n = brute_components(data, percent, size)
    assert sorted(map(tuple, got.select("doc_id", "n_shingles", "component_id").collect()), key=str) == want
    kept = ngram_join.keep_one(made, percent=percent, size=size, **how).select("doc_id", "text", "lang")
    assert kept.count() == n


@pytest.mark.parametrize(("percent", "size", "how"), [(90, 3, {}), (80, 5, {"block_classes": 7}), (90, 3, {"block_classes": 5, "block_tokens": 900})])
def test_jaccard_links_are_all_counted(spark, rows, percent, size, how):
    data = rows + [(d + 1000, *r) for d, *r in near_copies(7)]
    words = [(t or "").encode().lower().split() for _, t, *_ in data]
    sets = [{tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))} if w else set() for w in words]
    want = [(d, sum(k != j and bool(a) and 100 * len(a & b) >= percent * len(a | b) for j, b in enumerate(sets))) for k, ((d, *_), a) in enumerate(zip(data, sets, strict=True))]
    assert max(n for _, n in want) > 2
    got = ngram_join.jaccard_components(spark.createDataFrame(data, DOCS).repartition(4), percent, size, **how)
    assert Counter(map(tuple, got.select("doc_id", "n_links").collect())) == Counter(want)


def test_a_large_group_with_one_common_passage(spark):
    """Hundreds of texts that share a fifth of their words, some of them near copies of each other."""
    rng = random.Random(77)
    form = [f"form{k}" for k in range(20)]
    texts = []
    for k in range(400):
        own = form + [f"own{k}x{j}" for j in range(80)]
        texts.append(" ".join(own))
        if k % 4 == 0:
            near = list(own)
            near[rng.randrange(50, 100)] = "changed"
            texts.append(" ".join(near))
    data = [(k, t, "l", "c", "c", 7, "c") for k, t in enumerate(texts)]
    made = spark.createDataFrame(data, DOCS).repartition(4)
    got = ngram_join.jaccard_components(made, 90, 3, block_classes=60)
    want, _ = brute_components(data, 90, 3)
    assert sorted(map(tuple, got.select("doc_id", "n_shingles", "component_id").collect()), key=str) == want
    # The common passage makes no group of them all: hardly more than the near copies meet.
    own = ngram_join.classes(ngram_join.signatures(made.select("doc_id", "text"), 90, 3))
    groups = ngram_join.groups(ngram_join.rarest(ngram_join.postings(own), 90))
    assert groups.groupBy("g").count().agg(F.max("count")).first()[0] <= 40


def test_orders_are_intersected_for_each_pair():
    """Pairs that miss one of the orders are no candidates, though they are in one piece of work."""
    rng = np.random.default_rng(5)
    base = np.unique(rng.integers(0, 1 << 63, 100).astype(np.uint64))
    other = np.unique(rng.integers(0, 1 << 63, 100).astype(np.uint64))
    sets = [base, base[1:], other, other[:-1]]
    size = np.array(list(map(len, sets)))
    prefixes = [[ngram_join.prefix(s, 90, k) for s in sets] for k in (3, 4)]
    rare = [np.array(x, np.int64) for x in ([1, 5], [5], [1, 9], [9])]
    may = ngram_join.may_link(prefixes, rare, size, own := [0, 1, 2, 3], own, 90)
    assert sorted(map(tuple, np.argwhere(may).tolist())) == [(1, 0), (3, 2)]
    assert not ngram_join.may_link(prefixes, [np.array([k]) for k in range(4)], size, own, own, 90).any()
    assert not ngram_join.may_link([prefixes[0], [np.array([k], np.uint64) for k in range(4)]], rare, size, own, own, 90).any()


def test_keys_are_found_either_way(spark):
    rows = spark.createDataFrame([(k % 7, k) for k in range(50)], "id bigint, v int")
    keys = spark.createDataFrame([(1,), (1,), (3,)], "id bigint")
    a, b = (sorted(map(tuple, ngram_join.only(rows, keys, ["id"], most).collect())) for most in (0, 10))
    assert a == b and {x[0] for x in a} == {1, 3}


def test_jaccard_of_nothing(none):
    assert ngram_join.jaccard_components(none).count() == 0


# 3 -------------------------------------------------------------------------------------------------------------------------


def loop_best_fit(lengths, capacity):
    """Best-fit decreasing, one piece after the other; the number of sequences."""
    gaps = []
    for n in sorted(lengths, reverse=True):
        fit = min((g for g in gaps if g >= n), default=None)
        if fit is None:
            gaps.append(capacity - n)
        else:
            gaps[gaps.index(fit)] = fit - n
    return len(gaps)


def loop_round(gaps, pieces, lo, hi):
    """One round, one piece after the other: (piece, sequence) pairs."""
    slots = [(size, seq) for seq, gap in gaps if gap > lo for k in [max(gap // hi, 1)] for size in [hi] * (k - 1) + [gap - (k - 1) * hi]]
    out = []
    for length, key in sorted(((n, k) for k, n in pieces), key=lambda x: (-x[0], x[1])):
        fit = min((x for x in slots if x[0] >= length), key=lambda x: (x[0], -x[1]), default=None)
        if fit:
            slots.remove(fit)
            out.append((key, fit[1]))
    return sorted(out)


@pytest.mark.parametrize("ranges", [1, 7])
def test_a_round_gives_each_piece_its_successor(spark, ranges):
    rng = random.Random(44)
    for lo, hi, most in ((20, 30, 90), (5, 9, 40), (0, 3, 60)):
        gaps = [(-1 - k, rng.randint(1, most)) for k in range(70)]
        pieces = [(k, rng.choice([hi, rng.randint(lo + 1, hi)])) for k in range(150)]
        met, small = packing.match(spark.createDataFrame(gaps, "seq bigint, gap bigint").repartition(3), spark.createDataFrame(pieces, "key bigint, length bigint"), lo, hi, ranges)
        rows = met.unionByName(small)
        got = [tuple(r) for r in rows.select("kind", "seq", "gap", "key", "length").collect()]
        took = sorted((key, seq) for kind, seq, _, key, _ in got if kind == packing.TOOK)
        assert took == loop_round(gaps, pieces, lo, hi) and len(took) > 30
        assert sorted([k for kind, *_, k, _ in got if kind == packing.LEFT] + [k for k, _ in took]) == list(range(150))
        left = dict(gaps)
        for key, seq in took:
            left[seq] -= dict(pieces)[key]
        assert sorted(map(tuple, packing.gaps_after(rows).collect())) == sorted((s, g) for s, g in left.items() if g)


@pytest.mark.parametrize("range_rows", [50_000, 60])
def test_rounds_fill_about_as_best_fit_does(spark, range_rows):
    rng = random.Random(4)
    lengths = [rng.choice([rng.randint(1, 64), rng.randint(10, 35), 24]) for _ in range(500)]
    pieces = spark.createDataFrame([(k, n, "x") for k, n in enumerate(lengths)], "__key bigint, length bigint, sequence string")
    used = defaultdict(list)
    for r in packing.place(pieces, 64, range_rows).collect():
        used[r.sequence_id].append((r.offset, r.length))
    assert sorted(n for parts in used.values() for _, n in parts) == sorted(lengths)
    for parts in used.values():
        assert [o for o, _ in sorted(parts)] == [sum(n for _, n in sorted(parts)[:k]) for k in range(len(parts))] and sum(n for _, n in parts) <= 64
    assert len(used) <= loop_best_fit(lengths, 64) * 1.01 + 1


def test_packing(spark, rows, docs, none):
    tk = Tokenizer.from_file(BYTE)
    want = Counter()
    for d, t, *_ in rows:
        ids = tk.encode(t or "", add_special_tokens=False).ids + [2]
        stops, start = packing.cut_points(len(ids), 64), 0
        for k, stop in enumerate(stops):
            want[d, k, start, stop - start, zlib.crc32(np.array(ids[start:stop], "<u4").tobytes())] += 1
            start = stop
    got = packing.pack_documents(docs, BYTE, capacity=64, with_ids=True)
    rows_got = got.collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows_got) == want
    assert len({r.sequence_id for r in rows_got}) <= loop_best_fit([r.length for r in rows_got], 64) * 1.01 + 1
    whole = packing.sequences(got).collect()
    assert sum(r.n_tokens for r in whole) == sum(r.length for r in rows_got) and all(len(r.ids) == 4 * r.n_tokens <= 256 for r in whole)
    assert packing.pack_documents(none, BYTE).count() == 0


# 4 -------------------------------------------------------------------------------------------------------------------------

ODD = ["", " ", "a  b", " a", "a \n b", "x\n\ny z", "<|endoftext|> a", "a<|endoftext|>b", "it's 12 of b c d I'LL", "日本 語x 𝒳 é́ z\x1cq r", "a ", "a\tb c", "İstanbul ÀÉ ß", "zqxj qqqq", "²³ ª º ¼", "a\nb.\nc", "\na", "a\n"]


def test_byte_ids_are_the_librarys():
    rng = random.Random(5)
    letters = "abcdefghijklmnopqrstuvwxyzABCXYZ'.,!?-_ \n0123456789éüñßçèÀ€<|>"
    texts = ODD + ["".join(rng.choices(letters, k=rng.randint(1, 60))) for _ in range(1500)] + [prose(rng, 50) for _ in range(50)]
    own = ByteLevelEncoder(BYTE, limit=100)
    want = [own.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert [np.frombuffer(own.encode(t), "<u4").tolist() for t in texts] == want
    assert [np.frombuffer(b, "<u4").tolist() for b in own.encode_all(texts, most=500)] == want


def test_fragments_are_the_librarys(spark, docs, rows, none):
    rng = random.Random(6)
    letters = "abcdefghijklmnopqrstuvwxyzABCXYZ'.,!?-_ \n0123456789éüñßçèÀ€<|>"
    own = bpe_fragments.FragmentCoder(WORD, limit=100)
    for t in ODD + ["".join(rng.choices(letters, k=rng.randint(1, 60))) for _ in range(1500)]:
        ids = own.tokenizer.encode(t, add_special_tokens=False).ids
        got = np.frombuffer(own.encode(t), "<u4")
        assert got.tolist() == ids and own.decode(got) == own.tokenizer.decode(ids, skip_special_tokens=False)
    want = Counter()
    for d, t, *_ in rows:
        ids = own.tokenizer.encode(t or "", add_special_tokens=False).ids
        said = own.tokenizer.decode(ids, skip_special_tokens=False)
        want[d, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(said.encode()).hexdigest()] += 1
    assert Counter(map(tuple, bpe_fragments.round_trip(docs, WORD).collect())) == want
    decoded = bpe_fragments.decode_ids(bpe_fragments.encode_texts(docs, WORD), WORD)
    assert decoded.where(F.sha2("decoded", 256).isin([k[3] for k in want])).count() == len(rows)
    assert bpe_fragments.round_trip(none, WORD).count() == 0


SCRIPTS = "αβγΣςΆабвЯёЙعربيةَไทยภาषा日本語汉字한글かなガ“”‘’–—…€😀👩‍👧🇩🇪नमस्तेʼ\u0301\u200d\u00a0\u3000\u2028ﬁİſ①½०𝒳𐐀abZ1'.,"


def test_fragments_of_all_scripts(monkeypatch):
    rng = random.Random(66)
    own = bpe_fragments.FragmentCoder(WORD, limit=100)
    texts = ["".join(rng.choices(SCRIPTS + " \n", k=rng.randint(1, 40))) for _ in range(3000)] + ["Ελληνικά κείμενα", "Привет, мир!", "“quoted” – 5 €", "日本語のテキスト。", "a😀b"]
    want = [own.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    asked = []

    class Library:
        def __init__(self, of):
            self.of = of

        def __getattr__(self, name):
            return getattr(self.of, name)

        def encode(self, text, **how):
            asked.append(text)
            return self.of.encode(text, **how)

    monkeypatch.setattr(own, "tokenizer", Library(own.tokenizer))
    assert [np.frombuffer(own.encode(t), "<u4").tolist() for t in texts] == want
    assert not asked


def test_cuts_are_certain():
    own = bpe_fragments.FragmentCoder(WORD)
    assert own.cut("zqxj")[-1].endswith("\0") and "".join(own.cut("zqxj")) == "zqxj\0"
    assert any(len(own.cut(w)) > 1 for w in ("zqxj", "qzqz", "jxq"))


# 5 -------------------------------------------------------------------------------------------------------------------------

RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "", "block"), ("", "/ads/", "block"), ("a.net", "/x", "allow"), ("a.net", "/x", "block"), ("we.ird", "/a.b(c", "block")]
URLS = [None, "", "no scheme", "http://", "HTTP://WWW.Example.COM/en/71?q#f", "https://example.com/en/8", "http://xexample.com/en/7", "ftp://com", "s://com?/en/", "s://com/en/", "x://b.a.net/xyz", "x://net", "x://net#a/b", "x://h/ads/1", "x://h/adsx", "a://b://c/d", "x://WE.ird/a.b(cd", "x://we.ird/axb(c", "x://ÀCOM/en/"]


def brute_url(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    rest = rest.split("?")[0].split("#")[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest.split("/")[0])
    path = rest[len(host) :]
    fit = [(len(h) + len(p), len(h), v == "block", h + p, v) for h, p, v in RULES if (not h or host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fit, default=(0, 0, 0, None, "allow"))
    return host, path, best[3], best[4]


@pytest.mark.parametrize("inline", [64, 0])
def test_url_filter(spark, inline):
    rows = [(k, u, "clash") for k, u in enumerate(URLS + URLS[3:6])]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, host string")
    got = url_filter.filter_urls(pages, RULES, inline_rules=inline).orderBy("page_id").collect()
    assert [(r.host, r.path, r.rule, r.verdict) for r in got] == [brute_url(u) for _, u, _ in rows]
    assert url_filter.filter_urls(pages.limit(0), RULES).count() == 0 and url_filter.filter_urls(pages, []).where("verdict = 'allow'").count() == len(rows)


def test_rules_go_under_their_rarest_token():
    index = url_filter.index_rules([("a.com", "/en/x", "block"), ("", "/q", "block")], {"h:a": 5, "h:com": 90, "p:en": 3})
    assert set(index) == {"p:en", ""}


# 6 -------------------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize(("size", "most"), [(35, 512), (8, 512), (8, 1)])
def test_substring_dedup(spark, rows, docs, size, most):
    words = [(d, (t or "").encode().split()) for d, t, *_ in rows]
    times = Counter(tuple(w[k : k + size]) for _, w in words for k in range(len(w) - size + 1))
    want = Counter()
    for d, w in words:
        gone = {k + j for k in range(len(w) - size + 1) if times[tuple(w[k : k + size])] > 1 for j in range(size)}
        want[d, len(w), len(gone), hashlib.sha256(b" ".join(x for k, x in enumerate(w) if k not in gone)).hexdigest()] += 1
    assert Counter(map(tuple, substring_dedup.substring_dedup(docs, size, most).collect())) == want
    cut = substring_dedup.dedup_texts(docs, size, most)
    assert cut.columns == docs.columns and Counter(r.doc_id for r in cut.collect()) == Counter(d for d, _ in words)


def test_substring_dedup_of_nothing(none):
    assert substring_dedup.substring_dedup(none).count() == 0


def test_super_kmers_cover_all_windows():
    rng = np.random.default_rng(1)
    for n in (34, 35, 36, 300):
        h = rng.integers(0, 4, n).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        _, start, count = substring_dedup.super_kmers(h, 35)
        assert count.sum() == max(0, n - 34) and (start.tolist() == [0, *np.cumsum(count)[:-1].tolist()] if n > 34 else not len(start))


# 7 -------------------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("bits", [64, 4])
def test_exact_dedup(rows, docs, bits):
    last = 1 << 63
    groups = defaultdict(list)
    for d, t, *_ in rows:
        groups[norm(t)].append((-len(t or ""), last if d is None else d, d))
    want = Counter()
    for text, own in groups.items():
        keep = min(own, key=lambda x: x[:2])
        for k, x in enumerate(sorted(own, key=lambda x: x[:2])):
            want[x[2], keep[2], len(own), k == 0, hashlib.sha256(text.encode()).hexdigest()] += 1
    got = exact_dedup.exact_dedup(docs, bits=bits, min_chunk=8, max_chunk=40)
    assert Counter(map(tuple, got.select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect())) == want
    kept = exact_dedup.drop_copies(docs, bits=bits, min_chunk=8, max_chunk=40)
    assert kept.columns == docs.columns and sorted(norm(r.text) for r in kept.collect()) == sorted(groups)


def test_exact_dedup_with_many_shared_hashes(docs, none):
    a, b = (Counter(map(tuple, exact_dedup.exact_dedup(docs, **how).collect())) for how in ({"bits": 2, "max_shared": 1, "min_chunk": 4, "max_chunk": 9}, {}))
    assert a == b and exact_dedup.exact_dedup(none).count() == 0


# 8 -------------------------------------------------------------------------------------------------------------------------


def toxic_corpus():
    rng = random.Random(8)
    bad = ["slurro", "slurrent", "slurrity"]
    out = []
    for d in range(900):
        words = [rng.choice(["er", "on", "thing", "and", "while", "tion", "of"]) + rng.choice(["", "st", "re"]) for _ in range(rng.randint(5, 60))]
        toxic = d % 6 == 0
        if toxic:
            for _ in range(3):
                words[rng.randrange(len(words))] = rng.choice(bad)
        out.append((d, " ".join(words), int(toxic)))
    return out


def test_toxicity_on_held_out_rows(spark, none):
    rows = toxic_corpus()
    docs = spark.createDataFrame([(d, t, "l", "c", "c", 7, "c") for d, t, _ in rows] + [(None, None, None, None, None, None, None), (5000, "", "l", "c", "c", 7, "c"), (5001, "slurro", "l", "c", "c", 7, "c")], DOCS)
    labels = spark.createDataFrame([(d, x) for d, _, x in rows] + [(None, 1), (3, None)], "doc_id bigint, toxic int")
    got = {r.doc_id: r for r in toxicity.toxicity(docs, labels).collect()}
    assert got[None].held_out is False and 0 <= got[5000].score < 0.7 and got[5001].score > 0.5
    held = [(got[d], x) for d, _, x in rows if zlib.crc32(str(d).encode()) % 3 == 1]
    assert held and all(r.held_out for r, _ in held)
    assert sum(r.predicted == x for r, x in held) >= 0.97 * len(held)
    assert toxicity.toxicity(docs, labels.limit(0)).where("score <> 0").count() == 0
    assert toxicity.toxicity(none, labels).count() == 0


def brute_toxicity(rows):
    """Scores by models whose n-grams are kept as they are, in dictionaries."""
    order, shared, off, floor, all_parts = toxicity.ORDER, toxicity.SHARED, toxicity.DISCOUNT, toxicity.FLOOR, toxicity.ALL
    crc = {d: zlib.crc32(str(d).encode()) for d, *_ in rows}
    words = lambda t: {w.strip(toxicity._STRIP) for w in t.lower().split()} - {""}

    def fit(without):
        level = defaultdict(lambda: [0, 0])
        for d, t, toxic in rows:
            if crc[d] % 3 != 1 and crc[d] // 3 % toxicity.PARTS != without:
                for w in words(t):
                    padded = "\x02" * (order - 1) + w + "\x03"
                    for k in range(len(w) + 1):
                        level[padded[k : k + order]][1 - toxic] += 1
        shares, weights = {}, {}
        for k in range(order, shared, -1):
            total, below = defaultdict(lambda: [0, 0, 0, 0]), defaultdict(lambda: [0, 0])
            for g, own in level.items():
                for c in (0, 1):
                    total[g[:-1]][c] += own[c]
                    total[g[:-1]][2 + c] += own[c] > 0
                    below[g[1:]][c] += own[c] > 0
            for g, own in level.items():
                shares[g] = [max(own[c] - off, 0) / total[g[:-1]][c] if total[g[:-1]][c] else 0 for c in (0, 1)]
            for h, n in total.items():
                weights[h] = [n[2 + c] * off / n[c] if n[c] else 1 for c in (0, 1)]
            level = below
        total, kinds = Counter(), Counter()
        for g, own in level.items():
            total[g[0]] += sum(own)
            kinds[g[0]] += 1
        base = {g: (max(sum(own) - off, 0) + off * kinds[g[0]] * floor) / total[g[0]] for g, own in level.items()}
        return shares, weights, base

    def says(word, model):
        shares, weights, base = model
        padded, out = "\x02" * (order - 1) + word + "\x03", 0.0
        for k in range(len(word) + 1):
            g = padded[k : k + order]
            p = [max(floor, base.get(g[-shared:], floor))] * 2
            for n in range(shared + 1, order + 1):
                s, w = shares.get(g[-n:], (0, 0)), weights.get(g[-n:-1], (1, 1))
                p = [s[c] + w[c] * p[c] for c in (0, 1)]
            out += np.log(p[0]) - np.log(p[1])
        return out

    def features(text, model):
        own = sorted((says(w, model) for w in words(text)), reverse=True)
        if not own:
            return [0.0] * toxicity.N_FEATURES
        n, chars = len(own), sum(len(w) + 1 for w in words(text))
        beyond = [sum(max(x - k, 0) for x in own) for k in (1, 2, 3)]
        top = (own + [0.0] * toxicity.TOP)[: toxicity.TOP]
        return [sum(own) / chars, *top, *beyond, sum(x > 3 for x in own), np.log(n), len(text.split()) / n, sum(x > 2 for x in own) / n, beyond[1] / n**0.5]

    models = [fit(k) for k in range(toxicity.PARTS)] + [fit(None)]
    held = [(features(t, models[crc[d] // 3 % toxicity.PARTS]), x) for d, t, x in rows if crc[d] % 3 != 1]
    y = np.array([x for _, x in held], float)
    w = toxicity.logistic(np.array([f for f, _ in held]), y, toxicity.balanced(y))
    return {d: 1 / (1 + np.exp(-np.clip(w[0] + np.dot(w[1:], features(t, models[all_parts])), -40, 40))) for d, t, _ in rows}


@pytest.mark.parametrize(("grams", "words"), [(200_000, 200_000), (50, 20)])
def test_many_ngrams_score_as_unhashed_models_do(spark, monkeypatch, grams, words):
    monkeypatch.setattr(toxicity, "COMMON_GRAMS", grams)
    monkeypatch.setattr(toxicity, "COMMON_WORDS", words)
    rng = random.Random(88)
    letters = [chr(c) for c in range(0x3041, 0x3041 + 250)]
    junk = lambda: "".join(rng.choices(letters, k=8))
    rows = [(d, t + " " + " ".join(junk() for _ in range(25)) + " --- (er), ", x) for d, t, x in toxic_corpus()[:600]]
    # The classes overlap, so that the logistic fit does not run to its bounds.
    rows = [(d, t, x if d % 5 else 1 - x) for d, t, x in rows] + [(5000, "", 0), (5001, " ... ", 0)]
    # Rows that repeat a document that does not train.
    twice = next(r for r in rows if zlib.crc32(str(r[0]).encode()) % 3 == 1)
    docs = spark.createDataFrame([(d, t) for d, t, _ in rows] + [(5002, None)] + [twice[:2]] * 2, "doc_id bigint, text string")
    labels = spark.createDataFrame([(d, x) for d, _, x in rows] + [(rows[7][0], 0)], "doc_id bigint, toxic int")
    want = brute_toxicity(rows)
    got = toxicity.toxicity(docs, labels).collect()
    assert len(got) == len(rows) + 3
    assert max(abs(r.score - want[r.doc_id if r.doc_id != 5002 else 5000]) for r in got) < 1e-6


# 9 -------------------------------------------------------------------------------------------------------------------------


def scalar_thumbnail(data):
    """Another decoder for grey images with restart markers: one bit after the other."""
    at, tables, dri, out = 2, {}, 0, []
    while True:
        mark, n = data[at + 1], struct.unpack_from(">H", data, at + 2)[0]
        body = data[at + 4 : at + 2 + n]
        at += 2 + n
        if mark == 0xC4:
            codes, code, k = {}, 0, 17
            for size in range(1, 17):
                for _ in range(body[size]):
                    codes[size, code] = body[k]
                    code, k = code + 1, k + 1
                code <<= 1
            tables[body[0]] = codes
        elif mark == 0xC0:
            high, wide = struct.unpack_from(">HH", body, 1)
        elif mark == 0xDD:
            dri = struct.unpack(">H", body)[0]
        elif mark == 0xDB:
            step = body[1]
        elif mark == 0xDA:
            break
    scan = data[at:-2]
    blocks = wide // 8 * (high // 8)
    k = 0
    for first in range(0, blocks, dri):
        bits = []

        def read(n, bits=bits):
            nonlocal k
            while len(bits) < n:
                byte = scan[k]
                k += 2 if byte == 0xFF else 1
                bits += [byte >> s & 1 for s in range(7, -1, -1)]
            got = 0
            for _ in range(n):
                got = got << 1 | bits.pop(0)
            return got

        def symbol(table):
            size = code = 0
            while (size, code) not in table:
                code, size = code << 1 | read(1), size + 1
            return table[size, code]

        dc = 0
        for _ in range(min(dri, blocks - first)):
            size = symbol(tables[0])
            raw = read(size)
            dc += raw if not size or raw >> (size - 1) else raw - (1 << size) + 1
            assert symbol(tables[16]) == 0
            out.append(dc * step // 8 + 128)
        k += 2  # the marker
    return wide, high, bytes(out)


def test_jpeg(rows, docs, none):
    rng = random.Random(9)
    texts = [b"", b"a", b"\0\xff" * 300, rng.randbytes(3000), *((t or "").encode()[:5000] for _, t, *_ in rows[:30])]
    for text, data, frames in zip(texts, jpeg_media._media(texts), jpeg_media.decode(jpeg_media._media(texts)), strict=True):
        wide, high, pixels = scalar_thumbnail(data)
        (f,) = frames
        assert pixels == f.thumb.tobytes() == jpeg_media._padded(text).tobytes() and (f.width, f.height) == (wide, high)
    got = Counter((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in jpeg_media.media_features(jpeg_media.to_jpeg(docs)).collect())
    want = Counter()
    for d, t, *_ in rows:
        p = jpeg_media._padded((t or "").encode()).tobytes()
        want[d, len((t or "").encode()), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:])] += 1
    assert got == want and jpeg_media.media_features(jpeg_media.to_jpeg(none)).count() == 0


def test_jpeg_of_several_images():
    text = bytes(k % 251 for k in range(jpeg_media.ROW * jpeg_media.MOST_ROWS + 640))
    (frames,) = jpeg_media.decode(jpeg_media._media([text]))
    assert len(frames) == 2 and b"".join(f.thumb.tobytes() for f in frames) == text


def test_foreign_jpeg_with_ac_coefficients():
    """A grey image of two blocks whose AC codes have runs, values and no end-of-block in a full block."""
    dc, ac = jpeg_media._codes({0: 2, 3: 2, 5: 2}), jpeg_media._codes({0: 2, 0x21: 3, 0xF0: 3, 0x01: 3})
    bits = {("d", s): f"{c:0{n}b}" for s, n, c in dc} | {("a", s): f"{c:0{n}b}" for s, n, c in ac}
    stream = bits["d", 5] + "10110" + bits["a", 0x21] + "1" + bits["a", 0] + bits["d", 3] + "001"
    stream += "".join(bits["a", 0x01] + "0" for _ in range(63))
    stream += "1" * (-len(stream) % 8)
    scan = bytes(int(stream[k : k + 8], 2) for k in range(0, len(stream), 8)).replace(b"\xff", b"\xff\0")
    head = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xdb" + struct.pack(">HB", 67, 0) + bytes([16] * 64) + jpeg_media._dht(0, dc) + jpeg_media._dht(16, ac)
    data = head + b"\xff\xc0" + struct.pack(">HBHHBBBB", 11, 8, 8, 16, 1, 1, 0x11, 0) + b"\xff\xda" + struct.pack(">HBBBBBB", 8, 1, 1, 0, 0, 63, 0) + scan + b"\xff\xd9"
    ((f,),) = jpeg_media.decode([data])
    assert (f.width, f.height, f.thumb.tolist()) == (16, 8, [[min(255, (22 * 16 + 4) // 8 + 128), ((22 - 6) * 16 + 4) // 8 + 128]])


@pytest.mark.parametrize("interleaved", [True, False])
@pytest.mark.parametrize("restart", [0, 1])
def test_foreign_jpeg_in_colour(interleaved, restart):
    """Three components, luminance sampled twice as densely both ways, sides that no block divides; in one scan or one for each component."""
    rng = random.Random(99)
    wide, high = 43, 29
    luma = np.array([[rng.randint(-120, 120) for _ in range(6)] for _ in range(4)])  # 6 by 4 blocks, as the blocks of three by two MCUs
    chroma = [np.array([[rng.randint(-50, 50) for _ in range(3)] for _ in range(2)]) for _ in range(2)]
    dc = {size: f"{c:0{n}b}" for size, n, c in jpeg_media._DC}

    def scan(blocks):
        """blocks: one list of (component, value) for each MCU."""
        out, stream, last = b"", "", [0, 0, 0]
        for nth, mcu in enumerate(blocks):
            if restart and nth and nth % 2 == 0:
                stream += "1" * (-len(stream) % 8)
                out += bytes(int(stream[k : k + 8], 2) for k in range(0, len(stream), 8)).replace(b"\xff", b"\xff\0") + bytes([0xFF, 0xD0 + (nth // 2 - 1) % 8])
                stream, last = "", [0, 0, 0]
            for c, value in mcu:
                diff, last[c] = value - last[c], value
                size = abs(diff).bit_length()
                stream += dc[size] + (f"{diff if diff > 0 else diff + (1 << size) - 1:0{size}b}" if size else "") + "0"
        stream += "1" * (-len(stream) % 8)
        return out + bytes(int(stream[k : k + 8], 2) for k in range(0, len(stream), 8)).replace(b"\xff", b"\xff\0")

    frame = b"\xff\xc0" + struct.pack(">HBHHB", 17, 8, high, wide, 3) + bytes([1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0])
    head = b"\xff\xd8" + jpeg_media._TABLES + frame + (b"\xff\xdd" + struct.pack(">HH", 4, 2) if restart else b"")
    sos = lambda *parts: b"\xff\xda" + struct.pack(">HB", 6 + 2 * len(parts), len(parts)) + b"".join(bytes([c, 0]) for c in parts) + b"\0\x3f\0"
    if interleaved:
        mcus = [[(0, int(luma[2 * y + j, 2 * x + i])) for j in (0, 1) for i in (0, 1)] + [(1 + c, int(chroma[c][y, x])) for c in (0, 1)] for y in range(2) for x in range(3)]
        body = sos(1, 2, 3) + scan(mcus)
    else:
        body = sos(1) + scan([[(0, int(v))] for v in luma.reshape(-1)]) + b"".join(sos(2 + c) + scan([[(1 + c, int(v))] for v in chroma[c].reshape(-1)]) for c in (0, 1))
    ((f,),) = jpeg_media.decode([head + body + b"\xff\xd9"])
    assert (f.width, f.height) == (wide, high) and (f.thumb == luma + 128).all()


# 10 ------------------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("mode", ["byte", "bit"])
def test_token_files(docs, rows, none, mode):
    tk = Tokenizer.from_file(BYTE)
    ids = lambda t: tk.encode(t or "", add_special_tokens=False).ids + [2]
    shards = materialize(token_files.token_shards(docs, BYTE, mode=mode, shard_ids=300), "t", "none")
    got = sorted(map(tuple, token_files.read_documents(shards).select("start", "doc_id", "n_tokens", "ids_crc32").collect()))
    want = Counter((d, len(i), zlib.crc32(np.array(i, "<u4").tobytes())) for d, t, *_ in rows for i in [ids(t)])
    assert Counter(x[1:] for x in got) == want
    at = 0
    for start, _, n, _ in got:
        assert start == at
        at += n
    order = [d for _, d, *_ in got]
    assert order == sorted(order, key=lambda d: (d is not None, d or 0))
    assert token_files.write_and_read(none, BYTE).count() == 0


def test_shards_read_in_part():
    rng = np.random.default_rng(2)
    ids = rng.integers(0, 50_257, 1000).astype("<u4")
    for mode in ("byte", "bit"):
        r = token_files.ShardReader(token_files.ShardWriter(mode, block=96).write(ids, [(5, 400), (None, 600)]))
        assert (r.read() == ids).all() and (r.read(90, 200) == ids[90:200]).all() and r.docs == [(5, 400), (None, 600)]


def test_crcs_combine():
    rng = random.Random(1)
    for _ in range(50):
        a, b = rng.randbytes(rng.randrange(40)), rng.randbytes(rng.randrange(40))
        assert token_files.crc32_combine(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)


# Shared --------------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize(("path", "make"), [(BYTE, lambda p: token_ids.ByteLevelEncoder(p)), (WORD, lambda p: bpe_fragments.FragmentCoder(p))])
def test_other_tokenizers_are_refused(path, make, tmp_path):
    """A vocabulary whose steps are others gives no ids at all instead of wrong ones."""
    with open(path, encoding="utf-8") as f:
        made = json.load(f)
    for name, other in (("normalizer", {"type": "NFKC"}), ("pre_tokenizer", {"type": "Whitespace"}), ("model", made["model"] | {"ignore_merges": True})):
        (tmp_path / "t.json").write_text(json.dumps(made | {name: other}))
        with pytest.raises(ValueError, match=name):
            make(str(tmp_path / "t.json"))


def test_columns_of_any_name_stay(spark):
    """Columns named like the helpers of the dedup stages, or with a backtick in the name, come out as they went in."""
    rows = [(1, "one two three four five six", "a", "b", "c"), (1, "one two three four five six", "a", "b", "c"), (2, "one two three  four five six", "x", "y", "z"), (3, "else", "k", "l", "m")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, __d string, __own_sha string, `od``d` string")
    for out in (exact_dedup.drop_copies(docs), ngram_join.keep_one(docs, percent=80, size=5)):
        assert out.columns == docs.columns
        assert sorted(map(tuple, out.collect())) in ([rows[0], rows[3]], [rows[2], rows[3]])
    urls = spark.createDataFrame([("http://a.com/en/" + "x" * 300_000, "v"), (None, "w")], "url string, `od``d` string")
    got = {r[1]: r["verdict"] for r in url_filter.filter_urls(urls, [("com", "/en/", "block")]).collect()}
    assert got == {"v": "block", "w": "allow"}


def test_parts_of_a_group_are_one_block(spark):
    """A group that many tasks deal is in as few blocks as its size needs, so that a class travels a few times only."""
    from marlstone.llm import common, ngram_join

    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        rows = common.materialize(spark.range(400).selectExpr("1L AS g", "id", "100L + id % 3 AS n").unionByName(spark.range(6).selectExpr("2L + id % 3 AS g", "1000 + id AS id", "50L AS n")), "groups")
        laid_out = ngram_join.work(rows, 90, 100, 1_000_000).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert len(laid_out) <= 400 * 6 + 6
    together = {}
    for r in laid_out:
        together.setdefault((r.g, r.i, r.j), set()).add(r.id)
    assert all(len(x) < 2 * 2 * 100 for x in together.values())
    assert all(any({a, b} <= x for x in together.values()) for a, b in [(0, 399), (3, 200), (17, 18), (1000, 1003)])
