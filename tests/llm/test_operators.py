"""The numbered operators against plain brute-force versions, on small tables with awkward rows."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

from tallyspark.llm import ann, bpe, chat, components, langid, logfreq, mixing, queries, rules, simhash, toxicity, wordpiece

WORD = re.compile(r"[^\x20\x09-\x0D]+")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, word string, fp long, size long"
BASE = "the quick brown fox jumps over the lazy dog and runs away from the very big bear in the wood today"


def awkward() -> list[tuple]:
    texts = [
        (1, BASE), (2, BASE), (2, BASE), (3, BASE.replace("today", "now")), (4, None), (5, ""), (None, "No name here, twice."), (None, "No name here, twice."),
        (6, "  \t\n "), (7, "one"), (8, "one two"), (9, "a b c"), (10, "Ünïcode wörds ​ ça va bien\n\nça va bien"),
        (11, "x" * 3000), (12, "long " * 40_000), (13, "#*$ % & | <> words &&& $$$"), (14, "line one is here\nline one is here\nline one is here\n\n \nend"),
        (15, "12 34 -- 56"), (16, " ".join(f"w{k % 10}" for k in range(200))), (17, "ABC Def\x0bghi\x0cjkl\rmno"), (18, "tab\tsep  double"),
    ]
    more = [(100 + k, " ".join(f"{c}{k % 7}{j % 11}" for j, c in enumerate("abcdefghij" * 4))) for k in range(40)]
    return [(i, t, None if k % 9 == 4 else "ab"[k % 2], None if k % 8 == 3 else f"s{k % 3}", None, "extra", 7, 9) for k, (i, t) in enumerate(texts + more)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(awkward(), DOCS).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def crc(doc_id, of):
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % of


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


# op1


def conversations():
    rows = [(k, t, ["user", "assistant", "system", "tool <s>"][(k + t) % 4], f"say {k} {t} \\[INST] </s>\\\\<s>") for k in range(12) for t in range(k % 6 + 1)]
    rows += [(20, 0, "user", None), (20, 0, "user", None), (20, None, None, "x"), (20, 1, "assistant", "[/INST]\\"), (None, 1, "user", "q"), (None, 2, "assistant", " [/ASST]</s> ")]
    rows += [(30, t, "user" if t % 2 == 0 else "assistant", "é" * 50 + str(t)) for t in range(40)] + [(31, t, "user", "u" * 80) for t in range(30)]
    return rows


def said_by(rows):
    """The turns of each conversation in order, null role and text as empty."""
    by = defaultdict(list)
    for c, t, role, text in rows:
        by[c].append((t is not None, t or 0, role or "", text or ""))
    return {c: [x[2:] for x in sorted(turns)] for c, turns in by.items()}


def test_chat_round_trip(spark):
    rows = conversations() + [(40, 3, None, "b"), (40, 3, "", "a"), (40, 3, "", "c"), (40, 3, "assistant", None), (41, 0, "user", "word " * 200_000), (41, 1, "assistant", "<s>" * 50_000)]
    turns = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, example_no string").repartition(3)
    found = {r.conv_id: r for r in chat.example_digests(chat.prefix_target_examples(turns)).collect()}
    by = said_by(rows)
    assert found.keys() == by.keys()
    for c, said in by.items():
        loss = "".join(text for role, text in said if role == "assistant")
        r = found[c]
        assert (r.n_turns, r.loss_chars, r.n_targets) == (len(said), len(loss), sum(role == "assistant" for role, _ in said))
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in said).encode()).hexdigest()
        assert r.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()


def test_chat_examples_hold_whole_context_and_reply(spark):
    rows = [r for r in conversations() if r[0] != 41]
    rows += [(c, t, "assistant" if t % 3 == 2 else "user", f"{c} {t} <s> " + "é" * 40) for c in (51, 52) for t in range(60)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    pieces = chat.prefix_target_examples(turns).cache()
    by = said_by(rows)
    assert pieces.count() == len(rows)
    whole = chat.read_back(pieces).collect()
    for r in whole:
        assert chat.read_turns(r.text) == by[r.conv_id][: r.n_turns]
        role, said = by[r.conv_id][r.n_turns - 1]
        assert (r.loss_start is None) == (role != "assistant")
        assert r.loss_start is None or chat.unescape(r.text[r.loss_start : r.loss_end]) == said
    ends = {(c, k) for c, x in by.items() for k in range(1, len(x) + 1) if x[k - 1][0] == "assistant" or k == len(x)}
    assert len(whole) == len(ends) and {(r.conv_id, r.n_turns) for r in whole} == ends
    sizes = {r.conv_id: r.formatted_chars for r in chat.example_digests(chat.prefix_target_examples(turns)).collect()}
    assert sizes == {c: sum(len(r.text) for r in whole if r.conv_id == c) for c in by}
    one = chat.read_back(pieces, pieces.where("conv_id = 51 and turn_no = 60")).collect()
    assert [(r.n_turns, r.text) for r in one] == [(60, next(x.text for x in whole if (x.conv_id, x.n_turns) == (51, 60)))]
    assert chat.prefix_target_examples(turns.limit(0)).count() == 0


# op2


def test_lm_scores(docs, none):
    rows = awkward()
    tokens = {(i, t): [*WORD.findall(low(t)), "</end>"] for i, t, *_ in rows}
    train = Counter(w for i, t, *_ in rows if crc(i, 5) != 1 for w in tokens[i, t])
    n, v = sum(train.values()), len(train)
    for frequent in (4_000_000, 20):
        found = logfreq.lm_scores(docs, filter_bytes=1 << 20, frequent=frequent).collect()
        assert sorted((r.doc_id or -1, r.n_tokens) for r in found) == sorted((i or -1, len(tokens[i, t])) for i, t, *_ in rows)
        base = Counter((r.doc_id, r.held_out, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in found)
        assert base == Counter((i, crc(i, 5) == 1, sum(w in train for w in tokens[i, t]), n, round(sum(math.log10((train[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens[i, t]), 6)) for i, t, *_ in rows)
        assert all(r.score < 0 for r in found)
    assert logfreq.lm_scores(none, filter_bytes=1 << 20).count() == 0


def test_log_frequency_filter():
    rng = np.random.default_rng(1)
    h = np.unique(rng.integers(0, 2**63, 20_000, dtype=np.uint64))
    n = rng.integers(1, 5000, len(h)) // rng.integers(1, 3000, len(h)) + 1
    level = logfreq.quantised(n)
    size = 1 << int(level.sum() - 1).bit_length()
    bits = size * 8 // logfreq.SHARDS
    flags = np.zeros(size * 8, bool)
    logfreq.insert(flags, h, level, bits)
    held = np.packbits(flags, bitorder="little")
    got, exact = logfreq.lookup(held, h, bits), logfreq.LEVEL_COUNT[level]
    assert (got >= exact).all() and (got == exact).mean() > 0.97 and (got > 1.1 * exact + 1).mean() < 0.002
    assert (logfreq.lookup(held, rng.integers(0, 2**63, 20_000, dtype=np.uint64), bits) > 0).mean() < 0.05


def test_quantised_counts_are_near_and_in_order():
    n = np.unique(np.concatenate([np.arange(1, 5000), np.logspace(3, 13, 20_000).astype(np.int64)]))
    counts = logfreq.LEVEL_COUNT[logfreq.quantised(n)]
    assert (np.diff(counts) >= 0).all() and (counts[n <= 48] == n[n <= 48]).all()
    inside = n < 1e12
    assert (np.abs(counts / n - 1)[inside] < 0.011).all()
    assert (np.diff(logfreq.LEVEL_COUNT) > 0).all() and logfreq.LEVELS < 1 << 16


def test_lm_prefers_seen_text(spark):
    rows = [(k, f"alpha beta gamma delta {k % 5}") for k in range(200)] + [(5001, "alpha beta gamma delta 1"), (5002, "delta gamma beta alpha 1")]
    found = {r.doc_id: r for r in logfreq.lm_scores(spark.createDataFrame(rows, "doc_id long, text string"), filter_bytes=1 << 20).collect()}
    assert found[5001].score > found[5002].score + 1


def corpus(n=4000):
    rng = np.random.default_rng(4)
    return [(k, " ".join(f"w{x}" for x in (3000 * rng.random(60) ** 2).astype(int).tolist())) for k in range(n)]


def learned(rows):
    """Exact counts of the training texts by hash: words with BEGIN, and bigrams; N and V without BEGIN."""
    words, pairs = Counter(), Counter()
    for k, t in rows:
        if crc(k, 5) != 1:
            tokens, before, _ = logfreq.token_stream([(t or "").encode()])
            words.update(tokens.tolist() + [int(logfreq.BEGIN)])
            pairs.update(logfreq.bigram_hashes(before, tokens).tolist())
    return words, pairs, sum(words.values()) - words[int(logfreq.BEGIN)], len(words) - 1


def held_count(counts, h):
    """What an exact filter says of a hash."""
    return float(logfreq.LEVEL_COUNT[logfreq.quantised(np.array([counts[h]]))[0]])


def test_lm_scores_grow_with_the_corpus(spark):
    """A corpus of many times the items that one group holds scores like a model with exact quantised counts."""
    rows = corpus() + [(9001, None), (9002, ""), (9003, "w1 " * 30_000), (9003, "w1 " * 30_000), (9004, "never seen " * 5)]
    # a frequent word's levels must be few beside a shard's bits, as they are in a filter of megabytes
    small = 1 << 17
    table = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: r for r in logfreq.lm_scores(table, filter_bytes=small).collect()}
    large = {r.doc_id: r for r in logfreq.lm_scores(table, filter_bytes=1 << 22, frequent=50).collect()}
    made, groups = logfreq.sized_slices(logfreq.ngram_counts(table.where(~logfreq.held_out(F.col("doc_id"), 5, 1))), small)
    assert groups >= 4
    set_ = np.mean([np.unpackbits(logfreq.group_filter(made, g, small)).mean() for g in range(groups)])
    assert 0.1 < set_ <= 0.4
    words, pairs, _, v = learned(rows)
    n = sum(held_count(words, w) for w in words if w != int(logfreq.BEGIN))
    counted = logfreq.ngram_counts(table.where(~logfreq.held_out(F.col("doc_id"), 5, 1)), pairs=False).groupBy("h").agg(F.sum("n").alias("n"))
    assert logfreq.quantised_mass(counted) == pytest.approx(n)
    off, exact = [], []
    for k, t in rows:
        tokens, before, _ = logfreq.token_stream([(t or "").encode()])
        want = 0.0
        for a, b, ab in zip(before.tolist(), tokens.tolist(), logfreq.bigram_hashes(before, tokens).tolist()):
            left, single = held_count(words, a), held_count(words, b)
            want += math.log10((min(held_count(pairs, ab), left, single) + 64 * (single + 0.5) / (n + 0.5 * (v + 1))) / (left + 64))
        off.append((abs(found[k].score - want) / abs(want), abs(found[k].score - want) / len(tokens)))
        exact.append(abs(large[k].score - want) / abs(want))
    assert len(found) == len({k for k, _ in rows})
    whole, each = np.array(off).T
    # a false answer may add one to a rare bigram of a short text
    assert whole.mean() < 0.01 and each.max() < 0.2
    # a filter with room answers too high almost never
    assert np.mean(exact) < 1e-4 and max(exact) < 0.01


def test_lm_probabilities_sum_to_one(spark):
    """Over the whole vocabulary, by the counts that the filter gives, on average over contexts."""
    rng = np.random.default_rng(5)
    rows = [(k, " ".join(f"w{x}" for x in (300 * rng.random(100) ** 2).astype(int).tolist())) for k in range(3000)]
    size = 1 << 21
    counts = logfreq.ngram_counts(spark.createDataFrame(rows, "doc_id long, text string").where(~logfreq.held_out(F.col("doc_id"), 5, 1)))
    made, groups = logfreq.sized_slices(counts, size)
    assert groups == 1
    filter_, bits = logfreq.group_filter(made, 0, size), size * 8 // logfreq.SHARDS
    words, _, _, v = learned(rows)
    n = sum(held_count(words, w) for w in words if w != int(logfreq.BEGIN))
    vocabulary = np.array([w for w in words if w != int(logfreq.BEGIN)], np.uint64)
    single = logfreq.lookup(filter_, vocabulary, bits)
    p_word = (single + 0.5) / (n + 0.5 * (v + 1))
    # what is left of 1 is an unseen word's share
    assert p_word.sum() + 0.5 / (n + 0.5 * (v + 1)) == pytest.approx(1, abs=0.01)
    contexts = [w for w, _ in words.most_common(400) if w != int(logfreq.END)]
    for w in contexts:
        left = logfreq.lookup(filter_, np.array([w], np.uint64), bits)[0]
        pair = logfreq.lookup(filter_, logfreq.bigram_hashes(np.full(len(vocabulary), w, np.uint64), vocabulary), bits)
        p = (np.minimum(pair, np.minimum(left, single)) + 64 * p_word) / (left + 64)
        assert p.max() <= 1 and p.sum() == pytest.approx(1, abs=0.013)


def test_equal_texts_score_alike(spark):
    """Twenty sequences of 25 words, about as frequent: each is as likely as the other, and no word exceeds the first's share."""
    rng = np.random.default_rng(6)
    said = [" ".join(f"s{k}x{j}" for j in range(25)) for k in range(20)]
    rows = [(k, said[k % 20]) for k in rng.permutation(20_000).tolist()]
    found = logfreq.lm_scores(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), filter_bytes=1 << 20)
    scores = {k % 20: r.score for k, r in ((r.doc_id, r) for r in found.collect())}
    # the chance of the first word is one in twenty, that of the others nearly one
    n = Counter(k % 20 for k, _ in rows if crc(k, 5) != 1)
    for k, score in scores.items():
        p = (n[k] + 64 * (n[k] + 0.5) / (26 * sum(n.values()))) / (sum(n.values()) + 64)
        rest = 25 * math.log10((n[k] + 64 / (26 * 20)) / (n[k] + 64))
        assert score == pytest.approx(math.log10(p) + rest, rel=0.05) and score <= math.log10(0.06)
    assert max(scores.values()) - min(scores.values()) < 0.05 * abs(min(scores.values()))


def test_passes_do_not_grow_with_the_groups(spark):
    """A filter of many groups takes as many jobs as one of few, and gives the same scores."""
    rng = np.random.default_rng(7)
    rows = [(k, " ".join(f"w{x}" for x in rng.integers(0, 50_000, 200).tolist())) for k in range(3000)] + [(9001, None), (9003, "w1 w2 " * 60_000)]
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    sc, seen = spark.sparkContext, {}
    for size in (1 << 19, 1 << 15):
        sc.setJobGroup(f"filter {size}", "scores")
        scores = {r.doc_id: r.score for r in logfreq.lm_scores(table, filter_bytes=size).collect()}
        made, groups = logfreq.sized_slices(logfreq.ngram_counts(table.where(~logfreq.held_out(F.col("doc_id"), 5, 1))), size)
        seen[groups] = len(sc.statusTracker().getJobIdsForGroup(f"filter {size}")), scores
    sc.setLocalProperty("spark.jobGroup.id", None)
    few, many = min(seen), max(seen)
    assert many >= 16 * few and many >= 16
    assert seen[many][0] <= seen[few][0] + 12
    off = [abs(seen[many][1][k] - x) / abs(x) for k, x in seen[few][1].items()]
    assert np.mean(off) < 0.02


# op3


def fill(sizes, weights, share, ceiling):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    full, budget = set(), share * sum(sizes.values())
    while True:
        rest = budget - sum(ceiling * sizes[s] for s in full)
        open_ = sum(weight[s] for s in names if s not in full)
        target = {s: ceiling * sizes[s] if s in full else rest * weight[s] / open_ for s in names}
        above = {s for s in names if s not in full and target[s] > ceiling * sizes[s]}
        if not above:
            return target
        full |= above


def test_mixing(docs, none, monkeypatch):
    rows = awkward()
    sizes = defaultdict(int)
    for _, t, _, s, *_ in rows:
        sizes[s] += len(WORD.findall(t or ""))
    target = fill(sizes, queries.MIX_WEIGHTS, 1.5, 2.0)
    plan = mixing.repetition_plan(docs, queries.MIX_WEIGHTS).collect()
    assert Counter((r.doc_id, r.size, r.source_size, round(r.target, 6)) for r in plan) == Counter((i, len(WORD.findall(t or "")), sizes[s], round(target[s], 6)) for i, t, _, s, *_ in rows)
    assert all(0 <= r.copies <= 2 for r in plan)
    assert Counter(plan) == Counter(mixing.repetition_plan(docs, queries.MIX_WEIGHTS).collect())
    want = Counter()
    for r in plan:
        want[r.doc_id] += r.copies
    mixed = mixing.mix_sources(docs, queries.MIX_WEIGHTS)
    assert mixed.columns == docs.columns
    assert Counter(r.doc_id for r in mixed.collect()) == +want
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 0)
    assert Counter(mixing.repetition_plan(docs, queries.MIX_WEIGHTS).collect()) == Counter(plan)
    assert mixing.repetition_plan(none, queries.MIX_WEIGHTS).count() == 0
    assert mixing.mix_sources(none, queries.MIX_WEIGHTS).count() == 0


def test_filling_levels():
    rng = np.random.default_rng(14)
    for n in (1, 2, 5, 40):
        for share in (0.5, 1.5, 1.99, 2.5):
            sizes = {f"s{k:03}": int(x) for k, x in enumerate(rng.integers(0, 1000, n))}
            weight = np.array([queries.MIX_WEIGHTS[k % 3] for k in range(n)])
            size = np.array(list(sizes.values()), float)
            level = mixing.filled(weight, 2 * size, share * size.sum())
            got = np.minimum(2 * size, weight * level)
            assert got.sum() == pytest.approx(min(share, 2.0) * size.sum())
            if share <= 1.5:
                assert got == pytest.approx(list(fill(sizes, queries.MIX_WEIGHTS, share, 2.0).values()))


def test_mixing_comes_near_targets(spark):
    rows = [(k, "w " * (k % 13 + 1), f"s{k % 5 if k % 3 else 0}") for k in range(6000)]
    plan = mixing.repetition_plan(spark.createDataFrame(rows, "doc_id long, text string, source string"), queries.MIX_WEIGHTS).collect()
    took, target = Counter(), {}
    for r in plan:
        took[r.source_size] += r.size * r.copies
        target[r.source_size] = r.target
    assert all(abs(took[s] - t) < 0.05 * t for s, t in target.items())


# op4


def stats_of(text):
    words = WORD.findall(text or "")
    windows = [tuple(words[k : k + 8]) for k in range(len(words) - 7)]
    seen = Counter(windows)
    covered = {j for k, w in enumerate(windows) if seen[w] > 1 for j in range(k, k + 8)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def keeps(text):
    """The verdict of all rules, one after the other."""
    words, lines = WORD.findall(text or ""), (text or "").split("\n")
    n, chars, symbols, dup_lines, repeat_words = stats_of(text)
    stutter = sum(a == b for a, b in zip(words, words[1:]))
    failed = (n < 20, 100 * repeat_words > 30 * n, dup_lines > 2 and 10 * dup_lines > 3 * len(lines), 10 * symbols > n, not 2 * n <= chars <= 15 * n, 10 * stutter > 3 * n)
    return not any(failed)


def test_every_rule_like_its_plain_form(spark):
    ok = " ".join(f"word{k}" for k in range(40))
    texts = [ok, f"{ok} # $ % & *", f"{ok} # $", "a " * 10 + " ".join("abcdefghijklmnopqrstuvwxyz"), " ".join("x" * 40 + str(k) for k in range(30)), "\n".join([ok] + ["same line"] * 6), "\n".join([ok] + ["same line"] * 3),
             " ".join(f"w{k} w{k}" for k in range(30)), " ".join(f"w{k}" + " go" * (k % 4 == 0) * 2 for k in range(40)), ok + " " + ok, "ä ö ü " * 9, None, ""]
    texts += [t for _, t, *_ in awkward()] + ["\n".join(texts[k] or "" for k in (0, 2, 9))]
    found = rules.quality_verdicts(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)).collect()
    assert {r.doc_id: r.kept for r in found} == {k: keeps(t) for k, t in enumerate(texts)}
    assert {r.rejected_by for r in found} > {"few_words", None} and all((r.rejected_by is None) == r.kept for r in found)


def test_quality_rules(docs, none):
    rows = awkward()
    found = rules.quality_verdicts(docs, statistics=True).collect()
    assert Counter((r.doc_id, *(r[c] for c in rules.STATS)) for r in found) == Counter((i, *stats_of(t)) for i, t, *_ in rows)
    kept = {r.doc_id for r in found if r.kept}
    assert {1, 2, 3} <= kept and not kept & {4, 5, 6, 7, 13, 16}
    assert Counter((r.doc_id, r.kept) for r in rules.quality_verdicts(docs).collect()) == Counter((r.doc_id, r.kept) for r in found)
    assert rules.quality_verdicts(none, statistics=True).count() == 0


def test_cascade_order_changes_no_verdict():
    assert rules.cascade_order([(0, 0.5, 2.0), (1, 0.5, 1.0), (2, 0.0, 0.1)], 4) == [1, 0, 2, 3]
    texts = [None if t is None else t.encode() for _, t, *_ in awkward()]
    one, *_ = rules.run_cascade(rules.TextStats(texts), list(rules.RULES))
    two, *_ = rules.run_cascade(rules.TextStats(texts), list(rules.RULES)[::-1])
    assert ((one < 0) == (two < 0)).all()


# op5


def fingerprint_of(text):
    words = WORD.findall(low(text))
    shingles = [" ".join(words[k : k + 3]) for k in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components_of(prints, radius=2):
    """prints: (doc_id, fp) rows; the class of each row by brute force."""
    fps = sorted({f for _, f in prints})
    up = {f: f for f in fps}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in fps:
        for b in fps:
            if a < b and (a ^ b).bit_count() <= radius:
                up[find(a)] = find(b)
    least = defaultdict(list)
    for i, f in prints:
        least[find(f)].append(i)
    return Counter((i, f, min((x for x in least[find(f)] if x is not None), default=None)) for i, f in prints)


def test_simhash_components(docs, none):
    want = components_of([(i, fingerprint_of(t)) for i, t, *_ in awkward()])
    got = simhash.near_duplicate_components(docs).collect()
    assert Counter((r.doc_id, r.fp % 2**64, r.component_id) for r in got) == want
    assert simhash.near_duplicate_components(none).count() == 0


def test_fingerprint_links_join_all(spark, monkeypatch):
    for name, value in (("TILE", 300), ("NEAR_BLOCK", 32), ("HOME_BLOCK", 64)):
        monkeypatch.setattr(simhash, name, value)
    rng = np.random.default_rng(4)
    fps = set()
    for base in rng.integers(0, 2**63, 60, dtype=np.uint64).tolist():
        x = base
        for _ in range(25):
            fps.add(x)
            x ^= (1 << int(rng.integers(64))) | (1 << int(rng.integers(64)))
    hub = int(rng.integers(2**62))
    fps |= {hub ^ (1 << a) ^ (1 << b) for a in range(64) for b in range(a)}
    rows = [(k, f - 2**64 if f >= 2**63 else f) for k, f in enumerate(sorted(fps))]
    table = spark.createDataFrame(rows, "k long, fp long")
    links = simhash.fingerprint_links(table.select("fp"))
    assert links.count() < 60 * len(rows)
    roots = {r.node: r.root for r in simhash.connected_components(links).collect()}
    got = defaultdict(set)
    for k, f in rows:
        got[roots.get(f, f)].add(k)
    want = defaultdict(set)
    for (i, _, c), _n in components_of([(k, f % 2**64) for k, f in rows]).items():
        want[c].add(i)
    assert {frozenset(x) for x in got.values()} == {frozenset(x) for x in want.values()}


def test_links_of_a_hub_are_spread(spark, monkeypatch):
    """One node of thousands of links beside small groups: the components are right, and no part of the hub exceeds its limit."""
    monkeypatch.setattr(components, "HUB", 100)
    rng = np.random.default_rng(13)
    links = [(5, 1000 + k) for k in range(6000)] + [(9000 + 3 * k, 9000 + 3 * k + int(rng.integers(1, 3))) for k in range(500)] + [(70_000 + k, 70_001 + k) for k in range(40)]
    table = spark.createDataFrame(links, "a long, b long").repartition(4)
    got = {r.node: r.root for r in components.connected_components(table).collect()}
    assert got == {node: 5 if a == 5 else 70_000 if a >= 70_000 else a for a, b in links for node in (a, b)}
    pairs = table.select(F.col("a").alias("u"), F.col("b").alias("v"))
    dealt = components.spread(pairs, components._least(pairs), len(links))
    most = dealt.groupBy("u", "part").count().agg(F.max("count"), F.count("*")).first()
    assert dealt.count() == len(links) and most[0] <= 150 and dealt.where("u = 5").select("part").distinct().count() == 60


def test_one_per_component(docs, none):
    kept = simhash.one_per_component(docs)
    assert kept.columns == docs.columns
    rows = kept.collect()
    want = components_of([(i, fingerprint_of(t)) for i, t, *_ in awkward()])
    named = {c for (_, _, c) in want if c is not None}
    assert sorted(r.doc_id for r in rows if r.doc_id is not None) == sorted(named)
    assert len([r for r in rows if r.doc_id is None]) == len({f for (_, f, c) in want if c is None})
    assert simhash.one_per_component(none).count() == 0


def test_one_row_stays_of_each_component_in_any_order(spark):
    """Ids that repeat with other texts: no component loses its row or keeps two."""
    other = "nothing of all this has anything to do with the first text at all, and it goes on for a while"
    third = "a third one that is long enough as well to have a fingerprint which is far from those of both others"
    cases = [
        [(5, BASE), (5, other), (3, other)],
        [(5, BASE), (5, other), (3, BASE), (3, other)],
        [(None, BASE), (None, other), (4, other), (None, third), (None, third)],
        [(7, BASE), (7, BASE), (7, BASE), (8, other), (8, third), (9, None), (9, ""), (None, None)],
    ]
    for rows in cases:
        for order in (rows, rows[::-1]):
            kept = [tuple(r) for r in simhash.one_per_component(spark.createDataFrame(order, "doc_id long, text string")).collect()]
            groups = defaultdict(set)
            for i, t in rows:
                groups[fingerprint_of(t)].add((i is None, i or 0, i, t))
            want = {f: min(x[:3] for x in g) for f, g in groups.items()}
            got = defaultdict(list)
            for i, t in kept:
                got[fingerprint_of(t)].append((i is None, i or 0, i))
            assert got == {f: [w] for f, w in want.items()}, (rows, kept)


# op6


@pytest.fixture(scope="module")
def tiktoken_encoding():
    import tiktoken

    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.Codec(bpe.read_ranks(RANKS), public_tokenizers.PATTERN).ranks, special_tokens={})


def test_bpe_like_tiktoken(docs, none, tiktoken_encoding):
    want = Counter()
    for i, t, *_ in awkward():
        ids = tiktoken_encoding.encode_ordinary(t or "")
        want[i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()] += 1
    assert Counter(map(tuple, bpe.token_digests(docs, RANKS, public_tokenizers.PATTERN).collect())) == want
    assert bpe.token_digests(none, RANKS, public_tokenizers.PATTERN).count() == 0


def test_bpe_pieces_of_any_length(tiktoken_encoding):
    rng = np.random.default_rng(2)
    own = bpe.Codec(bpe.read_ranks(RANKS), public_tokenizers.PATTERN)
    texts = ["".join(rng.choice(list("aeinrst hlo"), int(n))) for n in rng.integers(1, 700, 60)]
    texts += ["".join(map(chr, rng.integers(32, 0x3000, 200))) for _ in range(20)] + ["ing" * 500, "n" * 1000, "ng" * 400 + "ing", "日本語" * 300, "🙂é" * 50]
    assert own.encode(texts) == [tiktoken_encoding.encode_ordinary(t) for t in texts]
    assert [own.decode(x).decode() for x in own.encode(texts)] == texts


def test_bpe_columns(spark, docs):
    encode, decode = bpe.encode_column(spark, RANKS, public_tokenizers.PATTERN), bpe.decode_column(spark, RANKS, public_tokenizers.PATTERN)
    rows = docs.select("text", decode(encode("text")).alias("back")).collect()
    assert all(bytes(r.back).decode() == (r.text or "") for r in rows)


# op7


def greedy_pieces(word, first, later):
    at, n = 0, 0
    while at < len(word):
        pieces = first if at == 0 else later
        end = next((e for e in range(len(word), at, -1) if word[at:e] in pieces), None)
        if end is None:
            return wordpiece.DEAD
        at, n = end, n + 1
    return n


def test_token_counts(docs, none):
    with open(RANKS, "rb") as f:
        first, later = map(set, wordpiece.vocabulary(f.read()))
    want = Counter()
    for i, t, *_ in awkward():
        words = (t or "").encode().split()
        n = {w: greedy_pieces(w, first, later) if len(w) < 1000 else None for w in set(words)}
        if None not in n.values():
            want[i, len(words), sum(n[w] for w in words), 0] += 1
    got = Counter(map(tuple, wordpiece.piece_counts(docs, RANKS).collect()))
    assert not want - got and sum(got.values()) == len(awkward())
    assert wordpiece.piece_counts(none, RANKS).count() == 0


def test_automaton_with_unknown_words():
    rng = np.random.default_rng(3)
    draw = lambda n, most: [bytes(rng.choice(list(b"abcd"), int(k))) for k in rng.integers(1, most, n)]
    for _ in range(20):
        first, later = set(draw(12, 5)), set(draw(12, 5))
        own = wordpiece.Automaton(sorted(first), sorted(later))
        words = draw(300, 12)
        assert own.counts(words).tolist() == [greedy_pieces(w, first, later) for w in words]


# op8


def test_codewords_are_apart():
    for k in (2, 3, 4, 5, 9):
        code = langid.codewords(k)
        assert len({tuple(x) for x in code.tolist()}) == k
        assert min((a != b).sum() for n, a in enumerate(code) for b in code[:n]) >= (k > 2) + 1 - (k == 2) * 0


def test_language_id(spark, none):
    rng = np.random.default_rng(6)
    sound = {"xx": "ka ro mi ta nu".split(), "yy": "the wh ing er sh".split(), "zz": "é où ça eau qu".split()}
    rows = [(k, " ".join("".join(rng.choice(sound[lang], 3)) for _ in range(30)), lang) for k in range(600) for lang in [list(sound)[k % 3]]]
    rows += [(None, None, "xx"), (9001, "", "yy"), (9002, "12 -- 3", "zz"), (9003, "— …", None), (9004, "Karo", None), (9005, rows[0][1], None), (9005, rows[0][1], None)]
    table = spark.createDataFrame([(*r, 0.0) for r in rows], "doc_id long, text string, lang string, score double").repartition(3)
    got = langid.predict_languages(table, sample_rows=200).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    lang = dict((r[0], r[2]) for r in rows)
    held = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 9000]
    assert held and all(crc(r.doc_id, 4) == 2 for r in held)
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in held]) > 0.98
    by = {r.doc_id: r.lang_pred for r in got}
    assert [by[k] for k in (None, 9001, 9002, 9003)] == ["und"] * 4 and by[9004] == "xx"
    assert langid.predict_languages(none).count() == 0
    assert {r.lang_pred for r in langid.predict_languages(table.withColumn("lang", F.lit(None).cast("string")).limit(5)).collect()} == {"und"}


def sounded(rng, sound, lang, n):
    return " ".join("".join(rng.choice(sound[lang], 3)) for _ in range(n))


SOUND = {"xx": "ka ro mi ta nu".split(), "yy": "the wh ing er sh".split(), "zz": "é où ça eau qu".split()}


@pytest.fixture(scope="module")
def language_model(spark):
    rng = np.random.default_rng(16)
    rows = [(k, sounded(rng, SOUND, lang, 30), lang) for k in range(300) for lang in [list(SOUND)[k % 3]]]
    return langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), sample_rows=200)


def decoded(model, text):
    """Language, score and ambiguity of one text, gram by gram."""
    if not any(c.isalpha() for c in text or ""):
        return "und", 0.0, False
    data = [32, 32] + [c if c > 127 or chr(c).isalpha() else 32 for c in text.lower().encode()]
    weights, n = np.zeros(model.weights.shape[1]), 0
    for k in range(2, len(data)):
        if data[k] != 32:
            _, two, three = langid.ngram_buckets(np.array(data[k - 2 : k + 1], np.uint8))
            weights += model.weights[two[-1]].astype(float) + model.weights[three[-1]].astype(float)
            n += 1
    margins = weights * langid.SCALE / n + model.bias
    loss = {lang: sum(t * math.log1p(math.exp(-m * c)) for m, c, t in zip(margins, model.code[k], model.trust[k])) for k, lang in enumerate(model.languages)}
    near = sorted(model.languages, key=lambda x: (loss[x], x))
    score = 1 / sum(math.exp(-4 * (d - loss[near[0]])) for d in loss.values())
    return near[0], score, loss[near[1]] - loss[near[0]] < langid.MARGIN * model.usual_lead[model.languages.index(near[0])]


def test_language_like_a_plain_decoder_in_any_company(language_model):
    rng = np.random.default_rng(17)
    texts = [sounded(rng, SOUND, list(SOUND)[k % 3], int(rng.integers(1, 40)))[: int(rng.integers(1, 200))] for k in range(120)]
    texts += [None, "", "12 34", "k", "a", "É", "K a r o", "x" * 300_000, "the " * 90_000, texts[0], texts[0]]
    want = [decoded(language_model, t) for t in texts if t is None or len(t) < 10_000]
    order = np.arange(len(texts))
    for _ in range(3):
        rng.shuffle(order)
        lang, score, ambiguous = language_model.predict([None if texts[k] is None else texts[k].lower().encode() for k in order])
        got = {k: x for k, x in zip(order.tolist(), zip(lang, score.tolist(), ambiguous.tolist()))}
        alone = [language_model.predict([None if t is None else t.lower().encode()]) for t in texts]
        assert [got[k] for k in range(len(texts))] == [(a[0], float(b[0]), bool(c[0])) for a, b, c in alone]
        plain = [got[k] for k, t in enumerate(texts) if t is None or len(t) < 10_000]
        assert [x[0] for x in plain] == [x[0] for x in want] and [x[2] for x in plain] == [x[2] for x in want]
        assert [x[1] for x in plain] == pytest.approx([x[1] for x in want], rel=1e-4)


def test_texts_in_two_languages_are_ambiguous(language_model):
    rng = np.random.default_rng(18)
    pure = [sounded(rng, SOUND, lang, 40).encode() for lang in SOUND for _ in range(20)]
    mixed = [" ".join(sounded(rng, SOUND, lang, 3) for _ in range(15) for lang in pair).encode() for pair in (("xx", "yy"), ("xx", "zz"), ("yy", "zz")) for _ in range(20)]
    assert np.mean(language_model.predict(pure)[2]) < 0.05
    assert np.mean(language_model.predict(mixed)[2]) > 0.3


def test_language_samples(spark):
    rng = np.random.default_rng(19)
    rows = [(k, sounded(rng, SOUND, "xx" if k % 50 else "yy", 20), "xx" if k % 50 else "yy") for k in range(1000)] + [(1003, sounded(rng, SOUND, "zz", 50), "zz")]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert langid.train(table, sample_rows=30).languages == ["xx", "yy", "zz"]
    a, b = ({tuple(r) for r in langid.predict_languages(t, sample_rows=100).collect()} for t in (table.repartition(3), table.orderBy(F.rand(3)).repartition(7)))
    assert a == b
    # the most frequent ones where a bound is given
    assert langid.train(table, languages=2).languages == ["xx", "yy"]


def test_more_languages_than_rows_of_each(spark):
    """Hundreds of languages: a row or a few of each are learned, and no number of them fails."""
    rng = np.random.default_rng(23)
    letters = list("abcdefghijklmnopqrstuvwxyz")
    kinds = {f"l{k:03}": ["".join(rng.choice(letters, 3)) for _ in range(4)] for k in range(600)}
    rows = [(3 * n + j, " ".join(rng.choice(words, 30)), lang) for n, (lang, words) in enumerate(kinds.items()) for j in range(3)]
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), sample_rows=100)
    assert len(model.languages) > 550 and model.code.shape[0] == len(model.languages)
    known = [(t, lang) for _, t, lang in rows if lang in model.languages][:200]
    found, _, _ = model.predict([t.encode() for t, _ in known])
    assert np.mean([a == b for a, (_, b) in zip(found, known, strict=True)]) > 0.8


# op9


def test_network_gradients():
    net = toxicity.Network(1)
    for k in net.p:
        net.p[k] = net.p[k].astype(np.float64)
    words = toxicity.Words([b"some words are here now", b"other longer words follow there", b"one"])
    begin, length, _ = words.windows()
    order = np.argsort(-length, kind="stable")
    ids, n = toxicity._rows(words, begin[order], length[order])
    x, label, weight = net.inputs(words).astype(np.float64), np.array([1.0, 0.0, 1.0]), np.array([1.0, 2.0, 1.0])

    def loss():
        return float((np.logaddexp(0, net.run(x, ids, n)) - label * net.run(x, ids, n)) @ weight / weight.sum())

    # states are kept in single precision, hence the tolerance
    g, dx = net.gradients(x, ids, n, label, weight)
    for value, grad in ((net.p["u_f"], g["u_f"]), (net.p["in_b"], g["in_b"]), (net.p["b_f"], g["b_f"]), (net.p["look"], g["look"]), (net.p["out"], g["out"]), (x, dx)):
        at = np.unravel_index(np.abs(grad).argmax(), grad.shape)
        old = value[at]
        value[at] = old + 1e-2
        up = loss()
        value[at] = old - 1e-2
        down = loss()
        value[at] = old
        assert (up - down) / 2e-2 == pytest.approx(grad[at], rel=0.03)


def test_network_like_a_plain_forward_pass():
    """One window at a time, one word at a time, in double precision, in any company and order."""
    net = toxicity.Network(3)
    net.slope, net.offset = 1.3, -0.2
    rng = np.random.default_rng(15)
    texts = [" ".join("".join(rng.choice(list("abcdeé"), int(rng.integers(1, 9)))) for _ in range(int(n))).encode() for n in (0, 1, 3, 47, 48, 49, 72, 73, 200)] + [None, b"12 !"]
    sig = lambda x: 1 / (1 + np.exp(-x))

    def logit(x):
        states = []
        for d, order in (("f", range(len(x))), ("b", range(len(x) - 1, -1, -1))):
            now, out, h = np.zeros(toxicity.HIDDEN), [None] * len(x), toxicity.HIDDEN
            for t in order:
                a, b = x[t] @ net.p[f"in_{d}"] + net.p[f"b_{d}"], now @ net.p[f"u_{d}"]
                z, r = sig(a[:h] + b[:h]), sig(a[h : 2 * h] + b[h : 2 * h])
                now = z * now + (1 - z) * np.tanh(a[2 * h :] + r * b[2 * h :])
                out[t] = now
            states.append(out)
        states = [np.concatenate([f, b]) for f, b in zip(*states)]
        if not states:
            return float(net.p["out_b"][0])
        look = np.array([s @ net.p["look"] for s in states])
        share = np.exp(look - look.max()) / np.exp(look - look.max()).sum()
        return float(sum(w * s for w, s in zip(share, states)) @ net.p["out"] + net.p["out_b"][0])

    def score(text):
        words = toxicity.Words([text])
        x = net.inputs(words).astype(np.float64)[words.ids]
        ends = [k for k in range(0, max(len(x) - toxicity.STRIDE, 1), toxicity.STRIDE)]
        return sig(net.slope * max(logit(x[k : k + toxicity.WINDOW]) for k in ends) + net.offset)

    want = [score(t) for t in texts]
    for order in (np.arange(len(texts)), rng.permutation(len(texts))):
        assert net.scores([texts[k] for k in order]) == pytest.approx([want[k] for k in order], abs=1e-4)
    assert net.scores(texts[4:5] * 3) == pytest.approx([want[4]] * 3, abs=1e-4)


def test_excerpts_of_long_texts():
    words = [b"w%d" % k for k in range(10_000)]
    assert toxicity.excerpt(b" ".join(words[:1024]), 1024) == b" ".join(words[:1024])
    cut = toxicity.excerpt(b" ".join(words), 1024).split()
    assert len(cut) <= 1024 and cut[0] == b"w0" and cut[-1] == b"w9999" and len(set(cut)) == len(cut)


def test_a_toxic_passage_anywhere_in_a_long_text_teaches(spark, monkeypatch):
    """No window of a sampled text is left out; where there are too many words, fewer texts are learned from."""
    seen = {}
    monkeypatch.setattr(toxicity, "fit", lambda texts, labels: seen.update(texts=texts, labels=labels))
    rows = [(k, "plain " * 9000 + ("gzorp " if k % 2 else "") + "plain " * 9000) for k in range(30)]
    train = lambda: toxicity.train(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(k, k % 2) for k in range(30)], "doc_id long, toxic int"))
    train()
    assert all(len(t.split()) > 18_000 - 1 and (b"gzorp" in t) == bool(k) for t, k in zip(seen["texts"], seen["labels"], strict=True))
    rows = [(k, f"w{k} " + t) for k, t in rows]
    train()
    many = len(seen["texts"])
    monkeypatch.setattr(toxicity, "TRAIN_WORDS", 80_000)
    train()
    assert 2 <= len(seen["texts"]) <= 8 < many and set(seen["labels"]) == {0, 1}


def test_labels_with_long_texts_only_are_learned(spark):
    rng = np.random.default_rng(20)
    plain = ["".join(rng.choice(list("aeiourstn"), 5)) for _ in range(200)]
    rows = [(k, " ".join([*rng.choice(plain, 1500), *(["gzorpal gzorpix"] * 20 if k % 2 else []), *rng.choice(plain, 100)])) for k in range(60)]
    net = toxicity.train(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(k, k % 2) for k in range(60)], "doc_id long, toxic int"))
    assert min(len(t) for _, t in rows) > 6000 and net is not None
    assert net.scores([rows[1][1].encode()])[0] > net.scores([rows[0][1].encode()])[0]


def test_toxicity(spark, none):
    rng = np.random.default_rng(8)
    plain = ["".join(rng.choice(list("aeiourstn"), 5)) for _ in range(300)]
    rows, marks = [], []
    for k in range(700):
        words = list(rng.choice(plain, int(rng.integers(5, 300))))
        if k % 4 == 0:
            words[int(rng.integers(len(words)))] = "gzorp" + str(rng.choice(["al", "en", "ix"]))
        rows.append((k, " ".join(words)))
        marks.append((k, int(k % 4 == 0)))
    rows += [(None, None), (9001, ""), (9002, "gzorpal " * 3), (9003, " ".join(rng.choice(plain, 5000)) + " gzorpix " + " ".join(rng.choice(plain, 5000)))]
    docs = spark.createDataFrame([(*r, 1.0) for r in rows], "doc_id long, text string, label double")
    labels = spark.createDataFrame([(*m, "x") for m in marks] + [(None, 1, "x"), (3, None, "x")], "doc_id long, toxic int, text string")
    got = toxicity.toxicity_scores(docs, labels).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    by = {r.doc_id: r for r in got}
    held = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 9000]
    assert all(crc(r.doc_id, 3) == 1 for r in held)
    assert np.mean([r.predicted == int(r.doc_id % 4 == 0) for r in held]) > 0.95
    assert [by[k].predicted for k in (None, 9001, 9002, 9003)] == [0, 0, 1, 1]
    assert toxicity.toxicity_scores(none.select("doc_id", "text"), labels).count() == 0
    assert {r.score for r in toxicity.toxicity_scores(docs.limit(3), labels.limit(0)).collect()} == {0.0}


# op10


def exact_nearest(rows, every, k):
    x = {i: np.array(v, np.float64) for i, v in rows}
    out = {}
    for q in x:
        if q % every == 0:
            out[q] = sorted((-float(x[q] @ v), i) for i, v in x.items() if i != q)[:k]
    return out


def test_nearest(spark):
    rng = np.random.default_rng(9)
    data = rng.standard_normal((2500, 24))
    data[300:900] = data[5] + 0.001 * rng.standard_normal((600, 24))
    data[1000:1100] = data[40]
    rows = [(k, [float(np.float32(v)) for v in x]) for k, x in enumerate(data)]
    bad = [(None, rows[0][1]), (5000, None), (5020, [0.0] * 24), (5040, [None] + [1.0] * 23), (5060, [float("nan")] * 24), (5080, [float("inf")] + [0.0] * 23), (5100, [1.0] * 3)]
    table = spark.createDataFrame([(*r, "x") for r in rows + bad], "vec_id long, embedding array<float>, rank string").repartition(4)
    got = ann.nearest(table).collect()
    want = exact_nearest([(i, np.float32(v)) for i, v in rows], 20, 20)
    by = defaultdict(dict)
    for r in got:
        by[r.query_id][r.rank] = (r.vec_id, r.score)
    assert by.keys() == want.keys() and all(sorted(x) == list(range(1, 21)) for x in by.values())
    hits = 0
    for q, near in want.items():
        score = {i: -s for s, i in near}
        found = [by[q][k] for k in range(1, 21)]
        assert found == sorted(found, key=lambda x: (-x[1], x[0]))
        hits += sum(i in score and score[i] == pytest.approx(s, rel=1e-12, abs=1e-12) for i, s in found)
    assert hits / (20 * len(want)) > 0.95
    assert ann.nearest(table.limit(0)).count() == 0
    far = defaultdict(set)
    for r in ann.nearest(table, metric="l2").collect():
        far[r.query_id].add(round(-r.score, 9))
    x = {i: np.array(np.float32(v), np.float64) for i, v in rows}
    close = {q: {round(float(d), 9) for d in sorted(((x[q] - v) ** 2).sum() for i, v in x.items() if i != q)[:20]} for q in far}
    assert np.mean([len(far[q] & close[q]) / len(close[q]) for q in far]) > 0.9
    few = ann.nearest(table.where("vec_id < 3")).collect()
    assert [(r.query_id, r.rank) for r in few] == [(0, 1), (0, 2)]


def test_nearest_over_many_blocks_and_groups(spark, monkeypatch):
    """More than five index blocks a part and several query groups, against brute force, and the rows that searches pass on."""
    for name, value in (("INDEX_BLOCK", 64), ("QUERY_BLOCK", 16), ("QUERY_GROUP", 40)):
        monkeypatch.setattr(ann, name, value)
    rng = np.random.default_rng(12)
    data = np.float32(rng.standard_normal((4000, 16)) + rng.integers(0, 3, (4000, 1)))
    rows = [(k, [float(v) for v in x]) for k, x in enumerate(data)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    want = exact_nearest(rows, 20, 20)
    by = defaultdict(list)
    for r in ann.nearest(table).collect():
        by[r.query_id].append((r.rank, r.vec_id, r.score))
    assert by.keys() == want.keys()
    hits = sum(len({i for _, i, _ in by[q]} & {i for _, i in near}) for q, near in want.items())
    assert hits / (20 * len(want)) > 0.99
    for q, found in by.items():
        assert [k for k, *_ in sorted(found)] == list(range(1, 21))
        assert [s for *_, s in sorted(found)] == sorted((s for *_, s in found), reverse=True)


def test_search_keeps_no_more_than_the_best():
    rng = np.random.default_rng(13)
    data = rng.standard_normal((3000, 12))
    quantiser = ann.fit(np.float32(data), 4, 32)
    codes, near = quantiser.encode(np.float32(data))
    found = ann.Search(quantiser, data[:50], np.arange(50), 7)
    for at in range(0, 3000, 250):
        part = slice(at, at + 250)
        found.add(np.arange(at, at + 250), data[part], codes[part], np.sqrt((near[part] ** 2).sum(axis=1)), np.sqrt(((data[part] - near[part]) ** 2).sum(axis=1)))
    out = found.found()
    assert out.num_rows == 50 * 7
    got = [set(out["vec_id"].to_pylist()[7 * q : 7 * q + 7]) for q in range(50)]
    exact = data[:50] @ data.T
    exact[np.arange(50), np.arange(50)] = -np.inf
    want = [set(x) for x in np.argsort(-exact, axis=1)[:, :7].tolist()]
    assert sum(len(a & b) for a, b in zip(got, want)) > 0.98 * 350


def test_nearest_with_repeated_query_rows(spark):
    rng = np.random.default_rng(3)
    data = [[float(np.float32(v)) for v in x] for x in rng.standard_normal((300, 8))]
    rows = list(enumerate(data)) + [(20, data[20])] * 2 + [(40, data[40])] * 24 + [(60, data[61])]
    asks = dict(enumerate(data)) | {60: min(data[60], data[61])}
    by = defaultdict(list)
    for r in ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4)).collect():
        by[r.query_id].append((r.rank, r.vec_id, r.score))
    assert by.keys() == set(range(0, 300, 20))
    for q, found in by.items():
        near = sorted((-float(np.dot(asks[q], v)), i) for i, v in rows if i != q)[:20]
        assert [(k, i) for k, i, _ in sorted(found)] == [(k, i) for k, (_, i) in enumerate(near, 1)]
        assert [x for _, _, x in sorted(found)] == pytest.approx([-x for x, _ in near])


# registration


def test_queries_run_over_whole_tables(spark, sf_dir):
    n = spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    for name in ("op3_source_mixing", "op4_quality_rules", "op6_byte_bpe", "op7_token_counts", "op8_language_id"):
        assert queries.QUERIES[name](spark, sf_dir).count() == n
