import collections
import hashlib
import random
import re
import resource
import zlib

import numpy as np
import public_tokenizers
import pytest
from brute import counts, groups, repeated, shingles, words

from pyspark.sql import functions as F

from tremor.llm import chat, fingerprints, jaccard, kernel, licences, mixing, packing, quality, repeats, shared, tokens

PATH = public_tokenizers.path("byte_bpe_50k.json")
SF = "/root/testdata/sf0.001"
ODD = [(1, "a b c d e f g", "x"), (1, "a b c d e f g", "x"), (None, None, None), (2, "", "x"), (3, "  \n\t ", None), (4, "A b C d e f g", "y"), (5, None, "y"), (6, "zz", "y"), (7, "é 🙂 <|endoftext|> [INST] \\ ß\x85\xa0\x1c", "z"), (8, "word " * 30000, "z")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty, repeated, equal and very long texts, and columns with names that the operators use themselves."""
    rows = [(i, t, s, "k", 0, 1, "m", 2, "r", 3) for i, t, s in ODD]
    names = "key string, rank int, place int, id_of string, mass_of int, runs string, source_of int"
    return spark.createDataFrame(rows, f"doc_id long, text string, source string, {names}")


@pytest.fixture(scope="module")
def empty(spark, docs):
    return spark.createDataFrame([], docs.schema)


def texts(df):
    return [(r["doc_id"], r["text"]) for r in df.collect()]


def test_words_and_sets(odd):
    data = [t or "" for _, t, _ in ODD] + [" x", "y ", "Ä b C", "a b"]
    enc = [t.encode() for t in data]
    for fold in (True, False):
        for lo, hi, w in kernel.word_chunks(enc, fold):
            assert [int(w.bounds[i + 1] - w.bounds[i]) for i in range(hi - lo)] == [len(words(t)) for t in data[lo:hi]]
    sets = [s for _, _, w in kernel.word_chunks(enc) for s in w.shingle_sets()]
    assert [len(s) for s in sets] == [len(shingles(t)) for t in data]
    assert list(sets[0]) == list(sets[5])  # case folded


def test_words_across_segments(monkeypatch):
    r = random.Random(1)
    enc = ["".join(r.choice("ab C\n\t é#!") for _ in range(r.randrange(200))).encode() for _ in range(300)]
    table = kernel._tables()
    monkeypatch.setattr(kernel, "_tables", lambda: table)
    plain = [(w.hashes.tolist(), w.starts.tolist(), w.ends.tolist()) for _, _, w in kernel.word_chunks(enc)]
    for size in (7, 64, 1000):
        monkeypatch.setattr(kernel, "SEGMENT", size)
        assert [(w.hashes.tolist(), w.starts.tolist(), w.ends.tolist()) for _, _, w in kernel.word_chunks(enc)] == plain


def test_a_text_of_100_megabytes():
    text = ("wörd and other words, Again! " * 3_500_000).encode()
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    ((_, _, words),) = kernel.word_chunks([text])
    assert len(words.hashes) == 17_500_000 and len(words.shingle_sets()[0]) == 5
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 10 * len(text) / 1024
    assert len(repeats.minimisers(words.windows(repeats.GRAM), words.bounds)[0]) > 17_500_000 // 30


def test_id_filter(spark):
    ids = spark.createDataFrame([(7,), (-1,), (1 << 62,), (None,)], "id long")
    asked = spark.createDataFrame([(7, 1), (-1, 2), (1 << 62, 3), (None, 4), *((i, 5) for i in range(100, 1100))], "x long, word int")
    found, others = shared.IdFilter(ids).split(asked, "x")
    kept, rest = ([r["x"] for r in df.collect()] for df in (found, others))
    assert {7, -1, 1 << 62} <= set(kept) and None in rest and len(kept) < 10 and len(kept) + len(rest) == 1004 and found.columns == asked.columns


def test_free_names(spark):
    df = spark.createDataFrame([(1, 2)], "Place int, place_ int")
    assert shared.free_name(df, "place") == "place__" and shared.free_name(df, "other") == "other"


def test_a_cluster_needs_a_checkpoint_folder(monkeypatch):
    from tremor import storage

    class Nothing:
        master = "spark://host:7077"
        _jsc = sc = getCheckpointDir = lambda self: self
        isEmpty = lambda self: True
        getConf = lambda self: {}

    nothing = Nothing()
    nothing._jsc = nothing
    session = type("Session", (), {"sparkContext": nothing})
    with pytest.raises(RuntimeError, match="checkpoint"):
        storage.shared_folder(session)


def test_quality(spark, docs, odd, empty):
    got = quality.quality_rules(docs).collect()
    by = dict(texts(docs))
    for r in got:
        want = counts(by[r["doc_id"]])
        assert tuple(r[c] for c in quality.COUNTS) == want
        assert r["base_failed"] == (want[0] < 10 or 100 * want[4] > 20 * want[0]) and not (r["kept"] and r["base_failed"])
    kept = {r["doc_id"] for r in got if r["kept"]}
    assert {r["doc_id"] for r in quality.keep_good(docs).collect()} == kept
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    good = [i for i, q in labels.items() if q == 1]
    assert sum(i in kept for i in good) > 0.9 * len(good)
    assert quality.quality_rules(empty).count() == quality.keep_good(empty).count() == 0
    assert quality.quality_rules(odd).count() == len(ODD)


def test_accuracies_of_rules_come_back():
    rng = np.random.default_rng(0)
    n, share = 100_000, 0.85
    right, caught, votes = [0.99, 0.95, 0.98, 0.9, 0.97, 0.99, 0.96], [0.6, 0.9, 0.3, 0.5, 0.2, 0.7, 0.05], [0.9, 1, 0.8, 0.95, 0.7, 1, 0.6]
    good, code = rng.random(n) < share, np.zeros(n, dtype=int)
    for j in range(len(quality.RULES)):
        vote = np.where(rng.random(n) < np.where(good, right[j], 1 - caught[j]), quality.GOOD, quality.BAD)
        code += 3**j * np.where(rng.random(n) < votes[j], vote, quality.ABSTAIN)
    found = quality.accuracies(dict(collections.Counter(code.tolist())))
    assert np.abs(found[0] - right).max() < 0.02 and np.abs(found[1] - caught).max() < 0.03 and abs(found[2] - share) < 0.02


def test_kept_is_the_plain_posterior(docs):
    """Bayes' rule written out for each row, with the accuracies that EM found."""
    rows = quality.measure(docs).collect()
    times = collections.Counter(r["votes"] for r in rows)
    right, caught, prior = quality.accuracies(dict(sorted(times.items())))
    for r in quality.quality_rules(docs).collect():
        votes = next(x["votes"] for x in rows if x["doc_id"] == r["doc_id"])
        good, bad = prior, 1 - prior
        for j in range(len(quality.RULES)):
            vote = votes // 3**j % 3
            if vote == quality.GOOD:
                good, bad = good * right[j], bad * (1 - caught[j])
            elif vote == quality.BAD and 1 - right[j] < caught[j]:
                good, bad = good * (1 - right[j]), bad * caught[j]
        assert abs(good / (good + bad) - r["quality"]) < 1e-6 and r["kept"] == (not r["base_failed"] and good >= bad)


def test_mixing(docs, odd, empty):
    rows = mixing.placed(docs, {"src0": 3.0, "src1": 1.0, mixing.REST: 2.0}, block_chars=4000).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(i for i, _ in texts(docs))
    owner = {}
    for r in rows:
        assert r["release"] <= r["slot"] < r["deadline"] and 0 <= r["offset"] <= 4000
        assert owner.setdefault(r["slot"], (r["stream"], r["block"])) == (r["stream"], r["block"])
    assert mixing.in_order(odd).count() == mixing.placed(odd).count() == len(ODD) and mixing.placed(empty).count() == 0
    assert mixing.in_order(docs).columns == docs.columns and mixing.in_order(odd).columns == odd.columns
    slots = {r["doc_id"]: (r["slot"], r["offset"]) for r in mixing.placed(docs).collect()}
    order = [slots[r["doc_id"]] for r in mixing.in_order(docs).collect()]
    assert order == sorted(order)


def test_schedule_stays_within_a_block():
    r = random.Random(5)
    for _ in range(30):
        parts = mixing.whole_weights({f"s{i}": r.random() + 0.01 for i in range(r.randrange(1, 9))})
        blocks = {s: r.randrange(1, 400) for s in parts}
        plan = {p["stream"]: p["phases"] for p in mixing.schedule(blocks, parts)}
        slot = lambda s, b: next(p["base"] + (b - p["block"]) // p["each"] * p["cycle"] + p["slots"][(b - p["block"]) % p["each"]] for p in reversed(plan[s]) if p["block"] <= b)
        order = sorted((slot(s, b), s) for s in blocks for b in range(blocks[s]))
        assert [t for t, _ in order] == list(range(sum(blocks.values())))
        left, share, done = dict(blocks), dict.fromkeys(blocks, 0.0), dict.fromkeys(blocks, 0)
        for _, s in order:
            live = sum(parts[x] for x in left)
            for x in left:
                share[x] += parts[x] / live
            done[s] += 1
            left[s] -= 1
            assert all(abs(done[x] - share[x]) < 1 + 1e-9 for x in left)
            if not left[s]:  # a new phase: the others start again from whole blocks
                del left[s]
                share = {x: float(done[x]) for x in left}


def test_licences(spark, odd, empty):
    held = licences.samples(9)
    families, vocabulary, w, b, t = licences.model()
    right = 0
    for text, family in held:
        z = (b + sum(w[vocabulary[g]] for g in licences.grams_of(text) if g in vocabulary)) / t
        p = np.exp(z - z.max())
        p /= p.sum()
        right += (families[int(p.argmax())] if p.max() >= licences.NAME_AT else licences.UNKNOWN) == family
    assert right > 0.93 * len(held)
    rows = [(1, "intro\nReleased under the MIT License.\n\nHe lost his driving license", 0), (2, "Licensed under the Apache License, Version 2.0.", 0)]
    got = {(r["doc_id"], r["paragraph"]): (r["family"], r["confirmed"]) for r in licences.licence_scan(spark.createDataFrame(rows, "doc_id long, text string, family int")).collect()}
    assert got == {(1, 1): ("MIT", True), (2, 0): ("Apache", True)}
    assert licences.licence_scan(odd).count() == licences.licence_scan(empty).count() == 0


def check_layout(laid):
    for r in laid.values():
        seen, parent = [], bytes(r["parent"])
        while parent:
            seen.append((laid[parent]["start"], laid[parent]["start"] + len(laid[parent]["ids"])))
            parent = bytes(laid[parent]["parent"])
        assert r["position"] == sum(b - a for a, b in seen) and r["depth"] == len(seen)
        held = {i for x in r["ancestors"] for i in range(x["from"], x["to"])}
        assert held == {i for a, b in seen for i in range(a, b)}


def test_chat(spark):
    odd = [(1, 0, "user", "a\\b<|end|>\n[INST]<|turn|>x\n"), (1, 1, "assistant", None), (1, 2, None, "x"), (1, 1, "assistant", None), (2, 0, "a\nb", "\\"), (3, 0, "assistant", "<|endoftext|>\x00 é"), (4, 0, "assistant", "<|endoftext|>\x00 é")]
    table = spark.createDataFrame(odd, "conv_id long, turn long, role string, text string")
    nodes, members = chat.chat_tree(chat.with_probe(table), PATH)
    got = {r["conv_id"]: r for r in chat.read_back(nodes, members, PATH).collect()}
    for conv in (1, 2, 3, 4, -7):
        own = sorted((k, r or "", t or "") for c, k, r, t in [*odd, (-7, 0, "user", chat.PROBE[1]), (-7, 1, "assistant", chat.PROBE[1])] if c == conv)
        loss = "".join(t for _, r, t in own if r == "assistant")
        want = (len(own), hashlib.sha256("".join(f"{r}\n{t}\n" for _, r, t in own).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert tuple(got[conv][k] for k in ("n_turns", "turns_sha256", "loss_chars", "loss_sha256")) == want
    # shared turns once, without gaps; what a node may attend to is what comes before it in its conversation
    laid = {bytes(r["node"]): r for r in nodes.collect()}
    spans = sorted((r["start"], len(r["ids"])) for r in laid.values())
    assert len(spans) == 4 + 1 + 1 + 2 and spans[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(spans, spans[1:], strict=False))
    check_layout(laid)
    assert got[3]["n_shared_turns"] == got[4]["n_shared_turns"] == 1 and got[1]["n_shared_turns"] == 0
    assert chat.formatted(table.limit(0), PATH).count() == 1


def test_token_counts(docs, odd, empty):
    library = tokens.tokenizer_at(PATH)
    for df in (docs, odd):
        got = sorted((r["doc_id"] or 0, r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in tokens.token_counts(df, PATH).collect())
        count = lambda t: len(library.encode(t or "", add_special_tokens=False).ids)
        assert got == sorted((i or 0, len((t or "").encode()), count(t), count(t) > 512) for i, t in texts(df))
    assert tokens.token_counts(empty, PATH).count() == 0


def test_tokens_of_odd_characters():
    r = random.Random(0)
    coder = tokens.Coder(PATH, sorted(tokens.whole_tokens(PATH)))
    alphabet = "ab cdé  \n\t'st'll123²½ªºÀſ…\x85\xa0　、中🙂<|endoftext|>Жю́ǅʰ€—\x1c\x1f\x00İß"
    for _ in range(3000):
        text = "".join(r.choice(alphabet) for _ in range(r.randrange(14))) + r.choice(["", "<|endoftext|>x"])
        want = coder.library.encode(text, add_special_tokens=False).ids
        assert coder.ids(text).tolist() == want and coder.count(text) == len(want)


def random_passages(seed, n):
    r = random.Random(seed)
    base = [[r.choice("abcdefghij") + str(r.randrange(99)) for _ in range(r.randrange(20, 90))] for _ in range(12)]
    out = []
    for i in range(n):
        w = []
        for _ in range(r.randrange(1, 6)):
            b = r.choice(base)
            a = r.randrange(20)
            w += b[a : r.randrange(a, len(b) + 1)]
            w += [r.choice("xyz")] * r.randrange(0, 70) if r.random() < 0.3 else []
            w += [str(r.random())] if r.random() < 0.5 else []
        out.append((i, " ".join(w)))
    return out


def test_repeats(spark, docs, odd, empty):
    made = spark.createDataFrame(random_passages(3, 250), "doc_id long, text string").repartition(5)
    for df in (docs, made):
        want = repeated(texts(df))
        got = {i: set() for i in want}
        for r in repeats.repeats(df).collect():
            got[r["doc_id"]] |= set(range(r["first_word"], r["end_word"]))
            assert r["n_words"] >= 50
        assert got == want and any(want.values())
    left = repeats.cut_repeats(docs)
    assert left.schema == docs.schema and not any(repeated(texts(left)).values()) and left.count() == docs.count()
    assert all(r["n_chars"] == len(r["text"]) for r in left.collect())
    assert repeats.repeats(empty).count() == repeats.cut_repeats(empty).count() == 0
    assert repeats.cut_repeats(odd).count() == len(ODD)


@pytest.mark.parametrize("kind", ["any", "few", "wide"])
def test_patterns_hold_all_pieces(kind):
    r = random.Random(kind)
    sizes = {"any": range(1, 2049), "few": [683, 682, 500, 700, 1024, 1025, 40, 2048], "wide": range(300, 1500)}[kind]
    need: dict = {}
    for _ in range(2000):
        s = r.choice(sizes)
        need[s] = need.get(s, 0) + 1
    (packed, at_least), alone = packing.configuration(need, 2048), packing.best_fit(need, 2048)
    held: dict = {}
    for pattern, times in packed:
        assert sum(s * a for s, a in pattern.items()) <= 2048
        for s, a in pattern.items():
            held[s] = held.get(s, 0) + a * times
    assert held == need
    used = sum(n for _, n in packed)
    assert at_least <= used <= sum(n for _, n in alone) and used <= 1.02 * at_least
    assert at_least >= -(-sum(s * n for s, n in need.items()) // 2048)


def test_packing(docs, odd, empty):
    library = tokens.tokenizer_at(PATH)
    for df in (docs, odd):
        rows = packing.pack(df, PATH).collect()
        by: dict = {}
        for r in rows:
            by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        for own in by.values():
            own.sort()
            assert own[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(own, own[1:], strict=False)) and sum(own[-1]) <= 2048
        want = []
        for i, t in texts(df):
            ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 0], dtype="<u4")
            ends = list(range((len(ids) - 1) % 2048 + 1, len(ids) + 1, 2048))
            want += [(i or 0, k, e - n, n, zlib.crc32(ids[e - n : e].tobytes())) for k, (e, n) in enumerate(zip(ends, np.diff([0, *ends]).tolist(), strict=True))]
        assert sorted((r["doc_id"] or 0, r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == sorted(want)
    assert packing.pack(empty, PATH).count() == 0


def test_fingerprints(docs, odd, empty):
    got = {r["doc_id"]: r for r in fingerprints.fingerprints(docs).collect()}
    rows = sorted(texts(docs))
    off = []
    for k, (i, t) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1]
        n = len(t)
        edited = t[: n - n // 2] + after[: n // 2]
        assert got[i]["n_chars"] == n and got[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        a, b, c = shingles(t), shingles(edited), shingles(after)
        off += [abs(got[i]["near_edited"] - len(a & b) / len(a | b)), abs(got[i]["near_next"] - len(a & c) / len(a | c))] if len(a) > 200 else []
    assert np.mean(off) < 0.05
    assert len({r["fingerprint"] for r in got.values()}) == len({frozenset(shingles(t)) for _, t in rows})
    assert fingerprints.fingerprints(odd).count() == len(ODD) and fingerprints.fingerprints(empty).count() == 0


def near_copies(seed):
    r = random.Random(seed)
    out = []
    for _ in range(12):
        base = [str(r.randrange(10**6)) for _ in range(r.randrange(6, 160))]
        for _ in range(r.randrange(1, 14)):
            w = list(base)
            for _ in range(r.randrange(0, max(1, len(w) // 18))):
                w[r.randrange(len(w))] = str(r.randrange(10**6))
            out.append(" ".join(w[r.randrange(0, 3) :]))
    r.shuffle(out)
    return list(enumerate(out))


@pytest.mark.parametrize("star", [300_000, 400])
def test_near_groups(spark, docs, odd, empty, star, monkeypatch):
    monkeypatch.setattr(jaccard, "STAR_SHINGLES", star)
    monkeypatch.setattr(jaccard, "HEAVY", 8 if star == 400 else 4096)  # the lane of frequent shingles too
    made = spark.createDataFrame(near_copies(4), "doc_id long, text string").repartition(5)
    for df in (docs, made):
        want = groups(texts(df))
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.near_groups(df).collect()}
        assert got == want and any(c != i for i, (_, c) in want.items())
    if star == 400:
        return
    kept = jaccard.keep_one(docs)
    assert sorted(i for i, _ in texts(kept)) == sorted({c for _, c in groups(texts(docs)).values()}) and kept.schema == docs.schema
    assert jaccard.near_groups(empty).count() == jaccard.keep_one(empty).count() == 0
    got = sorted((r["doc_id"] or 0, r["n_shingles"], r["component_id"]) for r in jaccard.near_groups(odd).collect())
    assert got[0] == (0, 0, None) and got[1:3] == [(1, 3, 1)] * 2 and (4, 3, 1) in got and (2, 0, 2) in got and len(got) == len(ODD)
    assert jaccard.keep_one(odd).count() == len(ODD) - 2


def test_components_of_chains(spark):
    r = random.Random(1)
    pairs = [(i, i + 1) for i in range(60)] + [(100 + i, 100) for i in range(1, 40)] + [(200, 201)]
    r.shuffle(pairs)
    got = {x["node"]: x["label"] for x in jaccard.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert all(label == (0 if n < 100 else 100 if n < 200 else 200) for n, label in got.items()) and len(got) == 61 + 40 + 2


def plain_scan(docs):
    """(doc_id, paragraph, lines, candidate, confirmed) by scoring every line and every run of lines."""
    families, vocabulary, w, b, temperature = licences.model()
    templates = [(f, licences.grams_of(t) & vocabulary.keys()) for f, ts in licences.TEMPLATES.items() for t in ts]

    def score(text):
        grams = licences.grams_of(text)
        z = (b.astype(float) + sum((np.round(w[vocabulary[g]].astype(float), 5) for g in grams if g in vocabulary), np.zeros(len(families)))) / temperature
        p = np.exp(z - z.max())
        family, chance = families[int(p.argmax())], float(p.max() / p.sum())
        share = max((len(grams & t) / len(t) for f, t in templates if f == family), default=0.0)
        return family if chance >= licences.NAME_AT else licences.UNKNOWN, share

    out = []
    for doc_id, text in docs:
        lines, k = (text or "").split("\n"), 0
        full = [bool(re.search("[^ \t\r\f]", x)) for x in lines] + [False]
        while k < len(lines):
            end = k
            while full[end]:
                end += 1
            best = collections.Counter()
            for j in range(k, end):
                family, share = score(lines[j])
                if family != licences.UNKNOWN:
                    out.append((doc_id, j, 1, family, share >= licences.CONFIRM_SHARE))
                    best[family] = max(best[family], share)
            if end - k > 1:
                family, share = score(" ".join(lines[k:end]))
                if family != licences.UNKNOWN and share > best[family]:
                    out.append((doc_id, k, end - k, family, share >= licences.CONFIRM_SHARE))
            k = max(end, k + 1)
    return sorted(out)


def test_licences_equal_a_plain_scorer(spark, docs):
    r = random.Random(3)
    words = sorted({w for t in [*licences.OTHERS, *(t for ts in licences.TEMPLATES.values() for t in ts)] for w in t.split()})
    made = [(i, "".join(r.choice(words) + r.choice([" ", " ", " ", " ", "\n", "\n\n"]) for _ in range(r.randrange(60)))) for i in range(200)]
    made += [(200 + i, f"{t}\n{r.choice(words)}\n \n{t.replace(' ', chr(10))}") for i, t in enumerate(t for ts in licences.TEMPLATES.values() for t in ts)]
    for df in (docs, spark.createDataFrame(made, "doc_id long, text string")):
        rows = licences.licence_scan(df).collect()
        assert sorted((x["doc_id"], x["paragraph"], x["lines"], x["candidate"], x["confirmed"]) for x in rows) == plain_scan(texts(df)) and rows
        assert all(x["family"] == (x["candidate"] if x["confirmed"] else licences.UNKNOWN) for x in rows)


def test_notices_of_other_wordings(spark):
    """None of these is a template or made from one; each is read the way a person would."""
    grant = licences.TEMPLATES["MIT"][-1].split()
    wrapped = "\n".join(" ".join(grant[i : i + 9]) for i in range(0, len(grant), 9))
    notices = {
        "The code in this folder is released under the MIT License, see the file beside it.": "MIT",
        "Copyright 2019 The Foo Team. Licensed under the Apache License, Version 2.0 (the License).": "Apache",
        "foo is free software, licensed under the GNU General Public License, version 3 or later": "GPL",
        "// SPDX-License-Identifier: MPL-2.0": "MPL",
        "Distributed under BSD terms": "BSD",
        "Our data are available under CC BY-SA 4.0.": "CC-BY-SA",
        "(c) 2021 Foo Ltd. All rights reserved.": "reserved",
        f"Some words\n\n{wrapped}\n \nmore words here": "MIT",
    }
    prose = [
        "Our apache helicopter unit distributed the new version 2.0 manual under the terms of the contract", "relicensed", "He lost his driving license", "The MIT published a study about licences of taxi drivers",
        "The general public is free to use the park", "Copyrights were a topic of the talk", "unlicensed products were sold at the market", "mit", "She works for the Mozilla office under a new manager",
    ]
    rows = [(i, t) for i, t in enumerate([*notices, *prose])]
    got = {}
    for r in licences.licence_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        got.setdefault(r["doc_id"], set()).add(r["family"])
    assert [got.get(i, set()) - {licences.UNKNOWN} for i in range(len(rows))] == [{f} for f in notices.values()] + [set()] * len(prose)


def test_every_source_has_its_own_stream(spark):
    rows = [(i, "x" * 30, f"s{i % 300:03}") for i in range(900)]
    got = mixing.placed(spark.createDataFrame(rows, "doc_id long, text string, source string"), block_chars=30).collect()
    assert {r["stream"] for r in got} == {f"s{i:03}" for i in range(300)}
    assert sorted(r["slot"] for r in got) == list(range(900))
    for r in got:
        assert r["release"] == 300 * r["block"] <= r["slot"] < r["deadline"] == 300 * (r["block"] + 1)


@pytest.mark.parametrize("weights", [{f"s{i}": 1.0 for i in range(30)}, {"a": 1e-4, "b": 0.3, "c": 0.6999}])
def test_schedule_keeps_the_weights_asked_for(weights):
    total, made = sum(weights.values()), {}
    for p in mixing.schedule({s: max(1, int(6000 * w / total)) for s, w in weights.items()}, mixing.whole_weights(weights)):
        x = p["phases"][0]
        for k in range(x["n"]):
            made[x["base"] + k // x["each"] * x["cycle"] + x["slots"][k % x["each"]]] = p["stream"]
    done = dict.fromkeys(weights, 0)
    for t in range(len(made)):
        done[made[t]] += 1
        assert all(abs(done[s] - (t + 1) * w / total) < 1 + 1e-9 for s, w in weights.items())


def test_chat_reads_through_the_intervals(spark):
    rows = [(1, 0, "user", "a b c"), (1, 1, "assistant", "d e"), (2, 0, "user", "a b c"), (2, 1, "user", "f")]
    nodes, members = chat.chat_tree(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), PATH)
    assert chat.read_back(nodes, members, PATH).count() == 2
    wrong = nodes.withColumn("position", F.col("position") + F.when(F.col("depth") == 1, 1).otherwise(0))
    with pytest.raises(Exception, match="does not fit the layout"):
        chat.read_back(wrong, members, PATH).collect()


def test_chat_trees_over_many_partitions(spark):
    """Many branches below one turn, a conversation of thousands of turns, rows without conv_id, clashing names."""
    r = random.Random(2)
    rows = [(c, k, "user" if k % 2 else "assistant", "start" if k == 0 else f"w{r.randrange(3)}") for c in range(300) for k in range(r.randrange(1, 7))]
    rows += [(1000, k, "user", f"t{k}") for k in range(5000)] + [(None, 0, "user", "lone"), (None, 0, "user", "lone"), (None, 5, "assistant", "x")]
    table = spark.createDataFrame([(*x, b"n", "p") for x in rows], "conv_id long, turn long, role string, text string, node binary, path string")
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        nodes, members = chat.chat_tree(chat.with_probe(table), PATH)
        laid = {bytes(x["node"]): x for x in nodes.collect()}
        shared_turns = {x["conv_id"]: x["n_turns"] for x in chat.read_back(nodes, members, PATH).collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    check_layout({k: x for k, x in laid.items() if x["depth"] < 50})
    spans = sorted((x["start"], len(x["ids"])) for x in laid.values())
    assert spans[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(spans, spans[1:], strict=False))
    assert shared_turns[1000] == 5000 and shared_turns[None] == 1 and chat.formatted(table, PATH).filter("conv_id is null").count() == 3
    paths = set()
    for c in range(300):
        own = tuple(t for x, _, _, t in rows if x == c)
        paths |= {own[: k + 1] for k in range(len(own))}
    assert len(laid) == len(paths) + 5000 + 2 + 2


@pytest.mark.parametrize("columns", ["false", "true"])
def test_hot_passage_over_partitions(spark, columns):
    """One passage in every text, and texts that are whole copies; small partitions that are not put together."""
    r = random.Random(8)
    words = lambda n: " ".join(str(r.randrange(10**6)) for _ in range(n))
    hot, whole = words(70), words(200)
    made = [(i, f"{words(r.randrange(30))} {hot if i % 3 else hot.rpartition(' ')[0]} {words(r.randrange(40))}") for i in range(200)] + [(500 + i, whole) for i in range(60)] + [(600, f"{whole} x {hot}")]
    made += [(700, " ".join(["same"] * 400)), (701, "a b " * 100)]
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", columns)
    try:
        want = repeated(made)
        got = {i: set() for i in want}
        for x in repeats.repeats(spark.createDataFrame(made, "doc_id long, text string").repartition(7)).collect():
            assert not got[x["doc_id"]] & set(range(x["first_word"], x["end_word"]))
            got[x["doc_id"]] |= set(range(x["first_word"], x["end_word"]))
        assert got == want
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)


def test_fingerprints_of_rows_without_id(spark):
    rows = [(None, f"text number {i} of several words in all") for i in range(50)] + [(i, f"numbered {i} text of words") for i in range(50)] + [(7, "another text for number seven")]
    got = fingerprints.fingerprints(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert len(got) == 101 and sum(r["doc_id"] is None for r in got) == 50
    by = {r["doc_id"]: r for r in got if r["doc_id"] is not None}
    t = "numbered 3 text of words"
    assert by[3]["edited_sha256"] == hashlib.sha256((t[: len(t) - len(t) // 2] + "numbered 4 text of words"[: len(t) // 2]).encode()).hexdigest()


def test_fingerprints_merge_into_fingerprints():
    sets = [np.unique(np.random.default_rng(x).integers(0, 1 << 63, 4000 * (x + 1)).astype(np.uint64) * np.uint64(2)) for x in range(3)]
    one, two, three = (fingerprints.fingerprint_text(x, fingerprints.sketch_of(x)) for x in sets)
    united = np.union1d(np.union1d(sets[0], sets[1]), sets[2])
    left, right = fingerprints.merge(fingerprints.merge(one, two), three), fingerprints.merge(one, fingerprints.merge(two, three))
    assert left == right and list(fingerprints.parse(left)[3]) == list(fingerprints.sketch_of(united)) and fingerprints.merge(left, left) == left
    alike, held = fingerprints.compare(one, left)
    assert held == 1.0 and abs(alike - len(sets[0]) / len(united)) < 0.02 and fingerprints.compare(one, one) == (1.0, 1.0)
    coarse = fingerprints.fingerprint_text(sets[0], fingerprints.sketch_of(sets[0], 16), 16)
    assert list(fingerprints.parse(fingerprints.merge(coarse, two))[3]) == list(fingerprints.sketch_of(np.union1d(sets[0], sets[1]), 16))
    assert fingerprints.compare(coarse, left)[1] == 1.0
