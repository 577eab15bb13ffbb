"""Line dedup, periodic runs and phrase mining against brute force, and their defined results on odd rows."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from groundwork.llm import lines, perfect, phrases, runs

OPERATORS = {
    "lines": lambda d: lines.drop_common_lines(d, least_docs=2, texts=True, keep=("source",)),
    "lines, routed": lambda d: lines.drop_common_lines(d, least_docs=2, texts=True, keep=("source",), in_place=-1),
    "runs": lambda d: runs.find_runs(d, texts=True),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows_clashing_names_and_no_rows(name, odd, clash):
    plain = OPERATORS[name](odd).collect()
    assert sorted(map(str, plain)) == sorted(map(str, OPERATORS[name](clash).collect()))
    assert sorted(str(r.doc_id) for r in plain) == sorted(str(r.doc_id) for r in odd.collect())
    assert OPERATORS[name](odd.limit(0)).count() == 0


def test_phrases_of_odd_rows_clashing_names_and_no_rows(odd, clash):
    mine = lambda d: phrases.mine_phrases(d, support=2)
    assert sorted(map(str, mine(odd).collect())) == sorted(map(str, mine(clash).collect())) and mine(odd).count() > 3
    assert mine(odd.limit(0)).count() == 0 and mine(odd.where("text is null")).count() == 0


# --- lines ---------------------------------------------------------------------------------------------------------
@pytest.mark.parametrize("n", [0, 1, 2, 63, 64, 65, 5000])
def test_perfect_hash(n):
    keys = np.random.default_rng(n).integers(0, 2**63, (n, 2), dtype=np.int64).view(np.uint64)
    index = perfect.PerfectHash.over(keys[:, 0], keys[:, 1])
    assert sorted(index.numbers(keys[:, 0], keys[:, 1]).tolist()) == list(range(n))
    assert len(index.bits) * 64 <= 6 * n + 1000
    again = perfect.PerfectHash(index.sizes, index.bits)
    other = again.numbers(keys[:, 1], keys[:, 0])
    assert ((other >= -1) & (other < max(n, 1))).all()


def line_key(line):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), line.strip(" \t\n\v\f\r"))


def without_common_lines(rows, least_docs):
    holders = defaultdict(list)
    for i, (_, text) in enumerate(rows):
        for k in {line_key(x) for x in (text or "").split("\n")}:
            if len(k) >= 40:
                holders[k].append(i)
    keepers = {k: max((rows[i][0] for i in own if rows[i][0] is not None), default=None) for k, own in holders.items() if len(own) >= least_docs}
    out = []
    for doc_id, text in rows:
        own = (text or "").split("\n")
        gone = [x for x in own if line_key(x) in keepers and keepers[line_key(x)] != doc_id]
        kept = "\n".join(x for x in own if not (line_key(x) in keepers and keepers[line_key(x)] != doc_id))
        out.append((doc_id, len(own), len(gone), max((len(holders[line_key(x)]) for x in gone), default=None), hashlib.sha256(kept.encode()).hexdigest(), kept))
    return sorted(out, key=str)


@pytest.mark.parametrize("in_place", [64 << 20, -1])
def test_common_lines_match_brute_force(make, in_place):
    rng = random.Random(5)
    pool = [f"Line {i} of the TEMPLATE, " + "with é and more words " * rng.randrange(1, 3) for i in range(60)]
    pool += ["x" * 39, "x" * 40, "é" * 39, "é" * 40, "", "short", " " + "nbsp stays at the ends of lines, always so"]
    hot = "the line that a third of all rows hold, word for word"
    rows = [(k if k % 11 else None, "\n".join([*rng.choices(["", " ", "\t"], k=1), *(rng.choice(["", " ", "\r"]) + rng.choice([x, x.upper(), x]) for x in rng.choices(pool, k=rng.randrange(6))), *([hot] if k % 3 == 0 else [])])) for k in range(120)]
    rows += [(2**62 + 7, hot + "\n" + pool[0]), (2**62 + 7, hot), (2**62 + 6, hot), (None, None), (5, "")] + [(9, rows[9][1])] * 3
    got = lines.drop_common_lines(make([(i, t, "en", "a") for i, t in rows]), texts=True, in_place=in_place, shard_keys=8, most_probes=20)
    got = sorted(((r.doc_id, r.n_lines, r.n_dropped, r.most_docs, r.kept_sha256, r.kept_text) for r in got.collect()), key=str)
    assert got == without_common_lines(rows, 5)


def test_keys_of_any_type(spark):
    line = "a line of more than forty characters, in every text"
    docs = spark.createDataFrame([(f"k{i}", line) for i in range(6)], "name string, text string")
    out = {r.name: r.n_dropped for r in lines.drop_common_lines(docs, key="name").collect()}
    assert out == {f"k{i}": int(i < 5) for i in range(6)}


# --- runs ----------------------------------------------------------------------------------------------------------
def all_runs(words, least_words, least_turns):
    found = {}
    for p in range(1, len(words) // least_turns + 1):
        i = 0
        while i + p < len(words):
            j = i
            while j + p < len(words) and words[j] == words[j + p]:
                j += 1
            if j > i and j - i + p >= max(least_words, least_turns * p):
                found.setdefault((i, j - i + p), p)
            i = max(j, i + 1)
    return sorted((a, n, p) for (a, n), p in found.items())


def collapsed(words, found):
    gone = {i for a, n, p in found for i in range(a + p, a + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def noisy_text(rng):
    n = rng.choice([0, 1, 5, 6, 30, 200])
    words = [rng.choice("abcdefgh"[: rng.choice([1, 2, 3, 8])]) for _ in range(n)]
    for _ in range(rng.randrange(3) if n else 0):
        a, p, length = rng.randrange(n), rng.randrange(1, 20), rng.randrange(1, 120)
        words[a : a + length] = [words[min(a + k % p, n - 1)] for k in range(min(length, n - a))]
    return rng.choice([" ", "\n", "\t "]).join(words)


@pytest.mark.parametrize("least", [(6, 4), (1, 2), (10, 3)])
def test_runs_match_brute_force(make, least):
    rng = random.Random(str(least))
    texts = [noisy_text(rng) for _ in range(300)] + [None, "", " \n "]
    out = {r.doc_id: r for r in runs.find_runs(make(texts), least_words=least[0], least_turns=least[1], texts=True).collect()}
    assert len(out) == len(texts)
    for i, text in enumerate(texts):
        words, r = (text or "").split(), out[i]
        want = all_runs(words, *least)
        assert r.runs == "".join(f"{a},{n},{p}\n" for a, n, p in want) and (r.n_words, r.n_runs) == (len(words), len(want))
        assert r.collapsed_text == collapsed(words, want) and r.collapsed_sha256 == hashlib.sha256(r.collapsed_text.encode()).hexdigest()
        best = min(want, key=lambda x: (-x[1], x[0], x[2]), default=(None, None, None))
        assert (r.start, r.length, r.period) == best and r.exponent_milli == (1000 * best[1] // best[2] if want else None)


def test_long_periods_in_a_long_text(make):
    rng = random.Random(1)
    phrase = [str(rng.randrange(10**6)) for _ in range(9000)]
    words = ["a", "b", *phrase * 5, *phrase[:77], "end"]
    r = runs.find_runs(make([" ".join(words), "c"])).orderBy("doc_id").first()
    assert (r.n_runs, r.start, r.length, r.period, r.exponent_milli) == (1, 2, 45077, 9000, 5008)


@pytest.mark.parametrize("seed", range(5))
def test_extensions_match_plain_comparison(seed):
    rng = np.random.default_rng(seed)
    words = np.concatenate([rng.integers(0, rng.integers(1, 4), 400), [99]])
    words[200:300] = words[50:150]
    lce = runs.Extensions(words)
    i, j = rng.integers(0, 401, (2, 3000))
    i, j = i[i != j], j[i != j]
    ends = np.append(words, [-1] * 401)
    want = [next(d for d in range(402) if max(a, b) + d >= 401 or ends[a + d] != ends[b + d]) for a, b in zip(i.tolist(), j.tolist())]
    assert lce.common(i, j).tolist() == want


def test_repeated_tails(make):
    texts = [" ".join(f"w{k}" for k in range(i % 37)) for i in range(400)]
    rows = [(i if i else None, t, "en", "a") for i, t in enumerate(texts)]
    out = {r.doc_id: r.text for r in runs.with_repeated_tails(make(rows)).collect()}
    assert len(out) == 400
    for doc_id, text, *_ in rows:
        words, h = text.split(), zlib.crc32(str(doc_id).encode())
        if doc_id is not None and h % 10 == 0 and words:
            g, n = h // 10, len(words)
            a, p = g % n, 1 + (n - g % n) // (3 + g % 8)
            words = [words[i if i < a else a + (i - a) % p] for i in range(n)]
            assert out[doc_id] == " ".join(words)
        else:
            assert out[doc_id].split() == words


# --- phrases -------------------------------------------------------------------------------------------------------
def collocations(rows, support, longest, top):
    n, f = Counter(), Counter()
    for lang, text in rows:
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\n-\r]", low):
            words = re.findall(r"[^ \t]+", piece)
            n[lang or "und"] += len(words)
            f.update((lang or "und", tuple(words[i : i + k])) for k in range(1, longest + 1) for i in range(len(words) - k + 1))
    often = {g: a for g, a in f.items() if len(g[1]) > 1 and a >= support}
    inside = Counter()
    for (lang, w), a in often.items():
        for i in range(len(w)):
            for j in range(i + 2, len(w) + 1):
                if j - i < len(w):
                    inside[lang, w[i:j]] = max(inside[lang, w[i:j]], a)
    out = []
    for (lang, w), a in often.items():
        score, _, left, right = min((1000 * a * n[lang] // (f[lang, w[:c]] * f[lang, w[c:]]), c, f[lang, w[:c]], f[lang, w[c:]]) for c in range(1, len(w)))
        if inside[lang, w] < a:
            out.append((lang, -score, -a, " ".join(w).encode(), left, right, n[lang]))
    ranks, final = Counter(), []
    for lang, score, a, phrase, left, right, total in sorted(out):
        ranks[lang] += 1
        if top is None or ranks[lang] <= top:
            final.append((lang, ranks[lang], phrase.decode(), -a, left, right, total, -score))
    return final


def phrase_rows(seed, n):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(40)] + ["É", "a\u00a0b", "s", "x\x00y", "ẞ", "it's"]
    fixed = [rng.choices(words, k=5) for _ in range(4)]
    out = []
    for i in range(n):
        text = []
        for _ in range(rng.randrange(12)):
            text += rng.choice(fixed)[rng.randrange(3) :] if rng.random() < 0.4 else rng.choices(words, k=rng.randrange(6), weights=[1 / (k + 1) for k in range(len(words))])
            text.append(rng.choice([".", ",", "\n", "\x0b", "", "", "S"]))
        joined = "".join(w + rng.choice([" ", "\t", "  "]) for w in text)
        out.append((rng.choice(["en", "de", None, "und"]), rng.choice([joined, joined.upper()]) if i % 9 else None))
    return out + [("en", "same words here")] * 60 + [("fr", "a b")]


@pytest.mark.parametrize("support,longest,top,shards", [(20, 5, 2000, 4), (5, 4, 7, 3), (2, 5, None, 1), (100, 2, None, 9)])
def test_phrases_match_brute_force(make, support, longest, top, shards):
    rows = phrase_rows(support, 300)
    docs = make([(i, t, lang, "s") for i, (lang, t) in enumerate(rows)])
    out = phrases.mine_phrases(docs, support=support, longest=longest, top=top, shards=shards).collect()
    assert sorted((r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in out) == sorted(collocations(rows, support, longest, top))


def test_buckets_hold_the_same_bits_and_every_locally_frequent_phrase(make):
    docs = make([(i, t, lang, "s") for i, (lang, t) in enumerate(phrase_rows(1, 200))])
    rows = phrases.encoded(docs, "lang", 2).selectExpr("*", "6L as support")
    one = phrases._frequent(rows, 1, None, 0, 16)
    assert (one == phrases._frequent(rows, 1, None, 5, 16)).all()
    two = phrases._frequent(rows, 2, one, 3, 16)
    local = Counter()
    for r in rows.collect():
        grams = phrases.Grams(r.lang, bytes(r.codes), bytes(r.words))
        keys = grams.keys(grams.hashes(2)[grams.whole(2)], r.shard)
        local.update(keys.tolist())
    keys = np.array([k for k, c in local.items() if c >= 6], dtype=np.uint64)
    assert len(keys) > 20 and phrases._in(two, keys).all() and np.unpackbits(two).sum() <= len(keys)


def test_products_past_64_bits(spark):
    got = spark.sql("select (cast(9000000000000000000 as decimal(19,0)) * cast(9000000000000000001 as decimal(19,0))) div (cast(3000000000000000000 as decimal(19,0)) * cast(8 as decimal(19,0))) as x").first().x
    assert got == 9000000000000000000 * 9000000000000000001 // (3000000000000000000 * 8)
