"""Operators against brute force on small tables, and the cases every stage must bear."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from folium.llm import exact_dedup, flac, html_extract, jaccard, licenses, lm_score, mixing, packing, preference, quality
from folium.llm.graph import components, joined
from folium.llm.queries import tokenizer_path
from folium.session import ensure_checkpoint_dir

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, bucket int, part string, digest string, key string, row int"


def corpus(spark, texts, ids=None, sources=None):
    """A documents table with extra columns whose names the operators use themselves."""
    rows = []
    for i, t in enumerate(texts):
        d = ids[i] if ids else i
        rows.append((d, t, "en", sources[i] if sources else f"s{i % 3}", len(t or ""), 1, "p", "d", "k", 5))
    return spark.createDataFrame(rows, SCHEMA)


def words(n, seed):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(2, 6))) for _ in range(n))


ODD = [None, "", "   \n\t ", "one", "x " * 5000, "é😀 ñ", "same text here now please", "same text here now please", words(300, 1)]


# --- preference ---------------------------------------------------------------------------------


def test_preference(spark):
    ddl = "pair_id long, turn long, role string, text string, prompt string"
    chosen = spark.createDataFrame([(1, 0, "user", "hi", "x"), (1, 1, "assistant", "yo", "x"), (2, 0, "user", "a", "x"), (3, 0, None, None, "x"), (None, 0, "user", "n", "x")], ddl)
    rejected = spark.createDataFrame([(1, 0, "user", "hi", "x"), (1, 1, "assistant", "no", "x"), (1, 2, "user", "ok", "x"), (2, 0, "user", "a", "x")], ddl)
    got = {r["pair_id"]: r for r in preference.format_preferences(chosen, rejected).collect()}
    one = got[1]
    assert one["prompt"] == "<|user|>\nhi<|end|>\n" and one["chosen"] == "<|assistant|>\nyo<|end|>\n" and one["prompt_turns"] == 1
    (span,) = one["chosen_spans"]
    assert one["chosen"][span["start"] : span["stop"]] == "yo<|end|>"
    (span,) = one["rejected_spans"]
    assert one["rejected"][span["start"] : span["stop"]] == "no<|end|>" and one["rejected"].endswith("<|user|>\nok<|end|>\n")
    assert got[2]["same"] and got[2]["chosen"] == "" and got[3]["complete"] is False and got[3]["chosen"] == "<||>\n<|end|>\n" and got[None]["prompt"] == ""
    assert preference.format_preferences(chosen.limit(0), rejected.limit(0)).count() == 0


# --- quality ------------------------------------------------------------------------------------


def test_quality(spark):
    good = [words(80, i) + "." for i in range(120)]
    bad = [" ".join([w] * 30) for w in words(120, 7).split()]
    d = corpus(spark, good + bad + ODD)
    labels = spark.createDataFrame([(i, int(i < 120), 0) for i in range(240)] + [(5, None, 0), (None, 1, 0), (999999, 1, 0)], "doc_id long, quality int, toxic int")
    got = quality.score(d, labels)
    rows = got.collect()
    assert set(d.columns) <= set(got.columns) and len(rows) == 240 + len(ODD) and all(0 <= r["score"] <= 1 for r in rows)
    held = [r for r in rows if r["held_out"] and r["doc_id"] < 240]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    assert sum(r["predicted"] == int(r["doc_id"] < 120) for r in held) / len(held) > 0.95
    assert quality.score(d.limit(0), labels).count() == 0
    none = quality.score(d, labels.limit(0)).select("score").distinct().collect()
    assert len(none) == 1


def test_forest_matches_walk():
    r = np.random.RandomState(0)
    x = r.rand(300, len(quality.FEATURES))
    f = quality.fit_forest(x, (x[:, 2] + x[:, 5] > 1).astype(float), quality.BoostParams(trees=5, depth=3))

    def walk(row):
        z = f.base
        for feature, threshold, value in zip(f.feature, f.threshold, f.value, strict=True):
            node = 0
            while node < 7:
                node = 2 * node + 1 + int(row[feature[node]] > threshold[node])
            z += value[node - 7]
        return 1 / (1 + math.exp(-z))

    assert np.allclose(f.score(x[:50]), [walk(row) for row in x[:50]])


# --- exact dedup --------------------------------------------------------------------------------


def test_binary_fuse():
    for n in (0, 1, 2, 10, 1000, 20000):
        keys = np.random.RandomState(n).randint(0, 2**63, n).astype(np.uint64)
        f = exact_dedup.build_filter(keys)
        assert f.contains(keys).all()
        other = np.random.RandomState(n + 1).randint(0, 2**63, 20000).astype(np.uint64)
        assert f.contains(other).mean() < 0.02


def test_exact_dedup(spark):
    texts = ODD + ["dup"] * 40 + [words(20, i % 7) for i in range(60)]
    ids = list(range(len(texts)))
    ids[-1] = ids[-2] = 500  # a repeated key
    d = corpus(spark, [*texts, "dup"], [*ids, 10])  # a repeated row
    got = exact_dedup.dedup(d.withColumn("_part", F.pmod(F.xxhash64("doc_id"), F.lit(2)).cast("int")), "_part", 2).collect()
    groups = {}
    for i, t in zip([*ids, 10], [*texts, "dup"], strict=True):
        groups.setdefault(t or "", []).append(i)
    assert len(got) == len(texts) + 1
    kept = Counter()
    for r in got:
        text = next(t for t in groups if hashlib.sha256(t.encode()).digest() == bytes(r["digest"]))
        assert r["keep_id"] == max(groups[text]) and r["group_size"] == len(groups[text])
        kept[text] += r["kept"]
    assert set(kept.values()) == {1}
    assert exact_dedup.dedup_against(d.limit(0), [d.limit(0)]).count() == 0
    news = exact_dedup.dedup_against(corpus(spark, ["dup", "new"], [900, 901]), [d])
    assert {r["doc_id"]: r["known"] for r in news.where("part = 0").collect()} == {900: True, 901: False}


# --- Jaccard join -------------------------------------------------------------------------------


def brute_components(texts, ids):
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append(frozenset([tuple(w)] if 0 < len(w) < 5 else (tuple(w[i : i + 5]) for i in range(len(w) - 4))))
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i in range(len(texts)):
        if ids[i] is not None:
            least[find(i)] = min(least.get(find(i), ids[i]), ids[i])
    return [(ids[i], len(sets[i]), least.get(find(i))) for i in range(len(texts))]


def test_jaccard(spark):
    r = random.Random(3)
    base = [words(60, 100 + i).split() for i in range(8)]
    passage = words(25, 77).split()
    texts = list(ODD)
    for b in base:
        for _ in range(8):
            w = list(b)
            for _ in range(r.randint(0, 5)):
                w[r.randrange(len(w))] = r.choice(["new", "other", "word"])
            texts.append(" ".join(w[: r.randint(50, 60)]))
    texts += [" ".join(words(40, 900 + i).split() + passage) for i in range(20)]
    texts += ["One two three FOUR", "one TWO three four", "one two three four five"]
    ids = list(range(len(texts)))
    got = sorted((x["doc_id"], x["n_shingles"], x["component_id"]) for x in jaccard.join_components(corpus(spark, texts, ids)).collect())
    assert got == brute_components(texts, ids)
    assert jaccard.join_components(corpus(spark, texts[:1]).limit(0)).count() == 0
    odd = jaccard.join_components(corpus(spark, ["a b c d e f", "a b c d e f", None], [None, 4, 4])).collect()
    assert {(x["doc_id"], x["component_id"]) for x in odd} == {(None, 4), (4, 4)}


def test_components(spark):
    r = random.Random(1)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(200)] + [(400 + i, 401 + i) for i in range(40)] + [(7, 7)]
    root = {}

    def find(i):
        root.setdefault(i, i)
        while root[i] != i:
            i = root[i]
        return i

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    touched = {x for e in edges if e[0] != e[1] for x in e}
    least = {}
    for x in touched:
        least[find(x)] = min(least.get(find(x), x), x)
    got = {(x["node"], x["root"]) for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {(x, least[find(x)]) for x in touched}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
    some, rest = (spark.createDataFrame(e, "a long, b long") for e in (edges[:120], edges[120:]))
    assert {(x["node"], x["root"]) for x in joined(components(some), rest).collect()} == {(x, least[find(x)]) for x in touched}


# --- licences -----------------------------------------------------------------------------------


def test_licenses(spark):
    apache, mit = licenses.NOTICES["Apache-2.0"], licenses.NOTICES["MIT"]
    files = [
        (1, "LICENSE", apache), (2, "a/b/x.py", "code"), (3, "a/LICENSE.md", "intro\n" + mit), (4, "a/b/c/y.py", None), (5, "z/w.py", ""),
        (6, "a/q.py", "# " + licenses.NOTICES["GPL-3.0"] + "\ncode"), (7, None, mit), (8, "ab/t.py", "licensed version public"),
    ]
    d = spark.createDataFrame([(*f, "x", 1.0) for f in files], "doc_id long, path string, text string, license_note string, score double")
    got = {r["doc_id"]: (r["own_license"], r["license"], r["inherited_from"]) for r in licenses.scan(d).collect()}
    assert got == {
        1: ("Apache-2.0", "Apache-2.0", None), 2: (None, "MIT", "a"), 3: ("MIT", "MIT", None), 4: (None, "MIT", "a"), 5: (None, "Apache-2.0", ""),
        6: ("GPL-3.0", "GPL-3.0", None), 7: ("MIT", "MIT", None), 8: (None, "Apache-2.0", ""),
    }
    assert licenses.scan(d.limit(0)).count() == 0


# --- FLAC ---------------------------------------------------------------------------------------


def test_flac(spark):
    r = np.random.RandomState(2)
    texts = [*ODD, "A" * 3000, words(900, 4), "".join(chr(c) for c in r.randint(32, 900, 2000))]
    rows = flac.round_trip(corpus(spark, texts)).orderBy("doc_id").collect()
    for row, t in zip(rows, texts, strict=True):
        raw = (t or "").encode()
        payload = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        assert (row["n_bytes"], row["payload_bytes"], row["payload_sha256"], row["tail_crc32"]) == (
            len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
    same = [r for r, t in zip(rows, texts, strict=True) if t == "same text here now please"]
    assert same[0]["media_sha256"] == same[1]["media_sha256"] and same[0]["feature"] == same[1]["feature"]
    media = flac.encode_texts(corpus(spark, texts))
    blocks = flac.decode_blocks(media).where("doc_id = 4").orderBy("block").collect()
    whole = b"".join(b["pcm"] for b in blocks)
    assert [b["sample_offset"] for b in blocks] == list(range(0, len(whole), flac.BLOCK)) and bytes((np.frombuffer(whole, np.int8).astype(np.int16) + 128).astype(np.uint8)).startswith(b"x x ")
    assert flac.round_trip(corpus(spark, texts).limit(0)).count() == 0


def test_flac_damage_and_forms():
    stream = flac.encode_payloads([flac.payload_of(words(500, 9))])[0]
    for at in (len(stream) - 30, len(stream) // 2):
        hurt = bytearray(stream)
        hurt[at] ^= 4
        with pytest.raises(flac.FlacError):
            flac.decode_streams([bytes(hurt)])
    with pytest.raises(flac.FlacError):
        flac.decode_streams([stream[: len(stream) // 2]])
    with pytest.raises(flac.FlacError):
        flac.decode_streams([b"RIFF"])
    info = flac.StreamInfo(stream)
    bare = stream[:4] + bytes([0x80]) + stream[5:42] + stream[info.frames_at :]  # without its seek table
    a, b = flac.decode_streams([stream])[0][1], flac.decode_streams([bare])[0][1]
    assert all((x == y).all() for x, y in zip(a, b, strict=True))


def test_flac_store_holds_a_share_at_a_time(spark, monkeypatch):
    """All streams are stored, never more than a part of them at once, and none is left behind."""
    texts = [*ODD, *(words(2000, i) for i in range(60))]
    d = corpus(spark, texts, ids=[i // 2 for i in range(len(texts))])
    ensure_checkpoint_dir(spark)
    root = Path(re.sub("^file:/*", "/", spark.sparkContext.getCheckpointDir()))
    size = lambda: sum(p.stat().st_size for p in root.rglob("*") if p.is_file())
    before, stored, read_back = size(), [], flac.read_back
    monkeypatch.setattr(flac, "read_back", lambda *a: stored.append(size() - before) or read_back(*a))
    rows = flac.round_trip(d).collect()
    media = sum(r["media_bytes"] for r in rows)
    want = sorted((i // 2, hashlib.sha256(flac.payload_of(t)).hexdigest()) for i, t in enumerate(texts))
    assert sorted((r["doc_id"], r["payload_sha256"]) for r in rows) == want
    assert stored and max(stored) < 0.5 * media and size() - before < 0.2 * media

    def fails(*_):
        raise RuntimeError("not read")

    monkeypatch.setattr(flac, "read_back", fails)
    before = size()
    with pytest.raises(RuntimeError):
        flac.round_trip(d)
    assert size() == before


# --- pages --------------------------------------------------------------------------------------


def test_html(spark):
    page = (
        "<html><head><title>Nope title words</title><style>p{}</style></head><body><div id='cookie-notice'>We use cookies here</div><header>Site head</header>"
        "<nav><ul><li><a href='/'>Home</a></li></ul></nav><article><h1>The  head&nbsp;line</h1><p>First <b>bold</b> &amp; more<br>text<p>Second &lt;b&gt; par"
        "<script>var x='<p>no</p>';</script><div class='ad'>Buy now</div></p></article><section class='comments'><p>A reader says so</p></section><footer>Foot</footer></body></html>"
    )
    rows = [(1, "u", page, "x"), (2, None, None, "x"), (3, "u", "", "x"), (4, "u", "<p>cut off &am", "x"), (1, "u", page, "x")]
    d = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = html_extract.extract(d).collect()
    want = "The head line\n\nFirst bold & more text\n\nSecond <b> par"
    assert sorted((r["page_id"], r["main_text"]) for r in got) == [(1, want), (1, want), (2, ""), (3, ""), (4, "cut off &am")]
    assert html_extract.extract(d.limit(0)).count() == 0


# --- language model -----------------------------------------------------------------------------


def test_lm(spark):
    texts = [words(60, i % 12) for i in range(60)] + ODD
    got = {r["doc_id"]: r for r in lm_score.score(corpus(spark, texts)).collect()}
    tokens = {i: (t or "").encode().lower().split() + [b""] for i, t in enumerate(texts)}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in tokens}
    counts = Counter(w for i, ws in tokens.items() if not held[i] for w in ws)
    n, v = sum(counts.values()), len(counts)
    for i, ws in tokens.items():
        r = got[i]
        base = math.fsum(math.log10((counts[w] + 1) / (n + v + 1)) for w in ws)
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[i], len(ws), sum(counts[w] > 0 for w in ws), n)
        assert math.isclose(r["base_score"], base, rel_tol=1e-9) and r["score"] < 0 and math.isfinite(r["score"])
    per_token = lambda rows: sum(got[i]["score"] for i in rows) / sum(len(tokens[i]) for i in rows)
    known = [i for i in tokens if held[i] and i < 60 and got[i]["n_known"] == len(tokens[i])]
    strange = [i for i in tokens if i >= 60 and got[i]["n_known"] < 0.5 * len(tokens[i])]
    assert known and all(per_token(known) > per_token([i]) for i in strange)
    assert lm_score.score(corpus(spark, texts).limit(0)).count() == 0


def test_urn_is_sequential():
    share, mixed = np.array([0.5, 0.2, 0.0]), np.array([0.1, 0.3, 0.05])
    sequence = [0, 1, 0, 2, 2, 0]
    total = []
    for w in lm_score.LAMBDAS:
        p = w * share + (1 - w) * mixed
        for urn in lm_score.URNS:
            lp, seen = 0.0, Counter()
            for t, x in enumerate(sequence):
                lp += math.log(p[x] if urn is None else (urn * p[x] + seen[x]) / (urn + t))
                seen[x] += 1
            total.append(lp)
    want = (max(total) + math.log(sum(math.exp(x - max(total)) for x in total) / len(total))) / math.log(10)
    got = lm_score.document_scores(share, mixed, np.array([0, 1, 2]), np.array([3.0, 1.0, 2.0]), np.array([0]), np.array([6]))
    assert math.isclose(got[0], want, rel_tol=1e-9)


# --- packing ------------------------------------------------------------------------------------


def test_packing(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    t.encode_special_tokens = True
    texts = [*ODD, words(2500, 3), "<|endoftext|> a  b\nc . d, é", *[words(n, n) for n in range(10, 200, 7)]]
    ids = [*range(len(texts) - 1), None]
    packed = packing.pack(packing.tokenize_pieces(corpus(spark, texts, ids), tokenizer_path(), keep_ids=True))
    rows = packed.collect()
    whole = {}
    for r in rows:
        whole.setdefault(r["doc_id"], {})[r["piece"]] = r
    for d, text in zip(ids, texts, strict=True):
        want = t.encode(text or "", add_special_tokens=False).ids + [2]
        parts = [whole[d][k] for k in range(len(whole[d]))]
        assert [x for p in parts for x in p["ids"]] == want and parts[0]["start"] == 0
        assert all(p["length"] == 1024 for p in parts[1:]) and all(p["length"] <= 1024 for p in parts)
        assert all(p["ids_crc32"] == zlib.crc32(np.array(p["ids"], "<u4").tobytes()) for p in parts)
    places = {}
    for r in rows:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for p in places.values():
        p.sort()
        assert [o for o, _ in p] == [sum(n for _, n in p[:i]) for i in range(len(p))] and sum(n for _, n in p) <= 1024
    assert len(places) <= -(-sum(r["length"] for r in rows) // 1024) + 1
    assert packing.sequences(packed).count() == len(places)
    assert packing.pack(packing.tokenize_pieces(corpus(spark, texts).limit(0), tokenizer_path())).count() == 0


def test_best_fit_plan_equals_one_by_one():
    r = random.Random(4)
    for _ in range(30):
        capacity = r.choice([16, 50, 100])
        histogram = Counter(r.randint(1, capacity) for _ in range(r.randint(1, 200)))
        bins = []
        for n in sorted(histogram.elements(), reverse=True):
            room = [b for b in bins if b >= n]
            if room:
                b = min(room)
                bins.remove(b)
                bins.append(b - n)
            else:
                bins.append(capacity - n)
        plan = packing.best_fit_plan(dict(histogram), capacity)
        used = {}
        for length, a, z, first, each, offset in plan:
            for k in range(z - a):
                used.setdefault(first + k // each, []).append((offset + (k % each) * length, length))
        assert sum(len(x) for x in used.values()) == sum(histogram.values())
        for x in used.values():
            x.sort()
            assert [o for o, _ in x] == [sum(n for _, n in x[:i]) for i in range(len(x))] and sum(n for _, n in x) <= capacity
        assert len(used) == len(bins)


# --- mixing -------------------------------------------------------------------------------------


def fill(sizes, weights, share, cap):
    target, open_ = {}, dict(sizes)
    left = share * sum(sizes.values())
    while open_:
        total = sum(weights[s] for s in open_)
        over = [s for s in open_ if left * weights[s] / total > cap * sizes[s]]
        if not over:
            return target | {s: left * weights[s] / total for s in open_}
        for s in over:
            target[s] = cap * sizes[s]
        left -= sum(target[s] for s in over)
        for s in over:
            del open_[s]
    return target


def test_mixing(spark):
    r = random.Random(8)
    texts = [words(r.randint(1, 60), i) for i in range(400)] + ODD
    sources = [r.choice(["a", "a", "a", "b", "c", "É", "d", None]) for _ in texts]
    sources[-1] = "empty"
    texts[-1] = None
    got = mixing.mix(corpus(spark, texts, sources=sources)).collect()
    sizes = {}
    for t, s in zip(texts, sources, strict=True):
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    order = sorted((s for s in sizes if s is not None)) + [None]
    weights = {s: [5, 2, 1][i % 3] for i, s in enumerate(order)}
    target = fill(sizes, weights, 1.5, 2.0)
    taken, biggest = Counter(), Counter()
    for row in got:
        assert row["source_size"] == sizes[row["source"]] and math.isclose(row["target"], target[row["source"]], rel_tol=1e-9, abs_tol=1e-9)
        assert 0 <= row["taken"] <= 2 * row["size"]
        taken[row["source"]] += row["taken"]
        biggest[row["source"]] = max(biggest[row["source"]], row["size"])
    for s in sizes:
        assert abs(taken[s] - target[s]) <= 2 * biggest[s] + 1e-6
    again = mixing.mix(corpus(spark, texts, sources=sources).repartition(7)).collect()
    assert sorted((x["doc_id"], x["taken"]) for x in got) == sorted((x["doc_id"], x["taken"]) for x in again)
    assert mixing.mix(corpus(spark, texts).limit(0)).count() == 0


def test_licenses_as_wholes(spark):
    """Licence files under their own holder, headers and titles that wrap, SPDX tags; prose about licences is none."""
    texts = licenses.read_texts()
    mpl = "# This Source Code Form is subject to the terms of the Mozilla Public\n# License, v. 2.0. If a copy of the MPL was not distributed with this\n" \
        "# file, You can obtain one at http://mozilla.org/MPL/2.0/.\nimport os\nprint(os.name)"
    gpl = "/*\n * This program is free software; you can redistribute it and/or modify\n * it under the terms of the GNU General Public License as published by\n" \
        " * the Free Software Foundation; either version 2 of the License, or\n * (at your option) any later version.\n */\nint main() { return 0; }"
    want = [(f"Copyright 2020 Ann Example\n\n{body}", name) for name, body in texts.items()]
    # A whole text of one line, and one that has lost its title, are known by their words.
    want += [(" ".join(texts["MIT"].split()), "MIT"), ("\n".join(texts["GPL-3.0"].splitlines()[8:]), "GPL-3.0")]
    want += [
        ("MIT License", "MIT"), ("x\ny\n    GNU GENERAL PUBLIC LICENSE\n       Version 3, 29 June 2007\nz", "GPL-3.0"),
        ("Mozilla Public License Version 2.0", "MPL-2.0"), ("Apache License", "Apache-2.0"), (mpl, "MPL-2.0"), (gpl, "GPL-2.0"),
        ("// SPDX-License-Identifier: MIT\ncode", "MIT"), ("# SPDX-License-Identifier: GPL-2.0-or-later\ncode", "GPL-2.0"),
        ("The permission to drive is a licence that most adults hold.\nIts terms differ.", None), ("mit dem Zug", None), (None, None),
    ]
    d = spark.createDataFrame([(i, f"{i}/LICENSE", t) for i, (t, _) in enumerate(want)] + [(900, "9/src/a.py", "code")], "doc_id long, path string, text string")
    got = {r["doc_id"]: r["license"] for r in licenses.scan(d).collect()}
    assert [got[i] for i in range(len(want))] == [name for _, name in want]
    assert got[900] == got[9]


def test_jaccard_regions_recurse(spark, monkeypatch):
    """Regions far above their bound, a shingle spread thinly over every stretch, entries in many small flushes."""
    monkeypatch.setattr(jaccard, "REGION", 16)
    monkeypatch.setattr(jaccard, "OVERSIZE", 12)
    monkeypatch.setattr(jaccard, "FLUSH", 300)
    monkeypatch.setattr(jaccard, "COUNTED", 200)
    r = random.Random(11)
    core = words(40, 500).split()
    texts = []
    for i in range(70):  # a cluster whose members lie on both sides of the threshold
        w = list(core)
        for _ in range(i % 6):
            w[r.randrange(len(w))] = r.choice(["new", "other", "word"])
        texts.append(" ".join(w[: 40 - i % 9]))
    thin = words(12, 501).split()
    texts += [" ".join(thin + words(4 + i % 3, 600 + i).split()) for i in range(40)]
    texts += [words(30, 700 + i) for i in range(30)]
    r.shuffle(texts)
    ids = list(range(len(texts)))
    d = corpus(spark, texts, ids).repartition(9)
    got = sorted((x["doc_id"], x["n_shingles"], x["component_id"]) for x in jaccard.join_components(d).collect())
    assert got == brute_components(texts, ids)


def test_html_scan_decides():
    """No element is snapped to: lists of links around the text are left out by their tags' weights alone."""
    links_ = "<ul>" + "".join(f"<li><a href='/{i}'>link {i}</a></li>" for i in range(12)) + "</ul>"
    body = "".join(f"<p>{words(30, i)}</p>" for i in range(5))
    page = html_extract.Page(f"<html><body><table><tr><td>{links_}</td></tr></table><div><h2 id='discussion'>On legal search</h2>{body}</div><div>{links_}</div></body></html>")
    weights = html_extract.tag_weights({})
    want = "\n\n".join(["On legal search", *(words(30, i) for i in range(5))])
    assert page.main_text(weights) == want
    assert page.main_text(dict.fromkeys(weights, 1.0)) != want  # without weights that tell, the whole page
    inside = html_extract.Page(f"<article><h1 class='search'>T</h1><section id='related-work'><p>{words(9, 1)}</p></section><section class='comments'>no</section></article>")
    assert inside.main_text(weights) == "T\n\n" + words(9, 1)


def test_best_stretch_is_best():
    r = random.Random(6)
    weights = html_extract.tag_weights({})
    for _ in range(40):
        source = "".join(r.choice(["<p>", "<li>", "</li>", "<a>", "</a>", "<div>", "</div>", "<hr>", "word ", "two words "]) for _ in range(30))
        page = html_extract.Page(source)
        worth = [len(t.split()) if tag is None else weights[tag] for tag, t in page.events]
        sums = [(sum(worth[i:j]), -i, -j) for i in range(len(worth)) for j in range(i + 1, len(worth) + 1)]
        first, last = page.best_stretch(weights)
        best = max((s for s, _, _ in sums), default=0)
        assert math.isclose(sum(worth[first:last]), max(best, 0), abs_tol=1e-9)
    assert html_extract.Page("<div>" * 200_000 + "deep <p>text").main_text(weights) == "deep\n\ntext"


def brute_decisions(docs, trained):
    """Cell parts and hits of every token, counting the other training documents' successors one by one."""
    pair = [b"\x01", b"\x02"]
    out = []
    for i, d in enumerate(docs):
        run, strange, row = 0, True, []
        for j, w in enumerate(d):
            context = tuple(([*pair[::-1], *d])[j : j + 2])
            after = Counter()
            for k, e in enumerate(docs):
                if k != i and trained[k]:
                    e2 = [*pair[::-1], *e]
                    after.update(e[m] for m in range(len(e)) if tuple(e2[m : m + 2]) == context)
            total = sum(after.values())
            top = max(after.values(), default=0)
            hit = total > 0 and after[w] == top and sum(n == top for n in after.values()) == 1
            row.append((total, top, hit, total > 0 and sum(n == top for n in after.values()) > 1, run, strange))
            run, strange = (run + 1 if hit else 0), total == 0
        out.append(row)
    return out


def test_decisions_are_those_of_the_others():
    r = random.Random(5)
    docs = [[r.choice([b"a", b"b", b"c", b"d"]) for _ in range(r.randint(1, 14))] + [b""] for _ in range(9)]
    docs += [docs[0], docs[1]]
    trained = [i % 4 != 1 for i in range(len(docs))]
    tokens = sorted({w for d in docs for w in d})
    place = {w: i for i, w in enumerate(tokens)}
    lengths = np.array([len(d) for d in docs])
    ids = np.array([place[w] for d in docs for w in d])
    q, f = lm_score.contexts_of(ids, np.cumsum(lengths) - lengths, lm_score.token_hashes(tokens), 60)
    cell, hit = lm_score.decisions(ids, lengths, np.array(trained), q, f, [])
    at = 0
    for row in brute_decisions(docs, trained):
        tied = False
        for total, top, hits, tie, run, strange in row:
            tied |= tie
            assert (cell[at] >= 0) == (total > 0)
            # Three successors left after the document's own are taken off may name another than the best; ties go by print.
            if total and not tied:
                seen = min(math.ceil(math.log2(total)), lm_score.SEEN - 1)
                assert cell[at] // 2 // lm_score.RUN // lm_score.SURE == seen
            at += 1
    assert hit.any() and at == len(ids)


def test_hit_mixer():
    r = np.random.RandomState(3)
    tally = np.zeros((lm_score.CELLS, 2), np.int64)
    truth = 1 / (1 + np.exp(-np.linspace(-3, 3, lm_score.CELLS)))
    n = r.randint(0, 400, lm_score.CELLS)
    tally[:, 1] = r.binomial(n, truth)
    tally[:, 0] = n - tally[:, 1]
    m = lm_score.HitMixer(tally.ravel())
    loss = lambda p: -(tally[:, 1] * np.log(p) + tally[:, 0] * np.log(1 - p)).sum()
    assert loss(m.hit) < loss(np.full(lm_score.CELLS, tally[:, 1].sum() / n.sum()))
    bits = m.log10().reshape(-1, 2)
    assert np.allclose(10 ** bits[:, 0] + 10 ** bits[:, 1], 1)


def test_lm_tells_texts_that_occur_twice(spark):
    texts = [words(60, 40 + i) for i in range(40)]
    texts += texts[:10]
    d = corpus(spark, texts)
    got = {r["doc_id"]: r for r in lm_score.score(d).collect()}
    twice = [got[i]["bits_per_byte"] for i in range(10) if not got[i + 40]["held_out"]]
    once = [got[i]["bits_per_byte"] for i in range(10, 40)]
    assert max(twice) < min(once)
    again = {r["doc_id"]: r["score"] for r in lm_score.score(d.repartition(7)).collect()}
    assert all(again[i] == got[i]["score"] for i in got)
    one = next(i for i in range(10) if not got[i + 40]["held_out"])
    shuffled = corpus(spark, [*texts, " ".join(sorted(texts[one].split()))])
    other = {r["doc_id"]: r["score"] for r in lm_score.score(shuffled).collect()}
    assert other[50] < other[one]  # the same words in another order


def stereo_stream(left, right, joint, bits):
    """A FLAC stream of one frame with verbatim subframes, written bit by bit."""
    side = left - right
    a, b = {0: (left, right), 8: (left, side), 9: (side, right), 10: ((left + right) >> 1, side)}[joint or 0]
    widths = {0: (bits, bits), 8: (bits, bits + 1), 9: (bits + 1, bits), 10: (bits, bits + 1)}[joint or 0]
    n = len(left)
    head = bytes([0xFF, 0xF8, 0x70, ((joint or 1) << 4) | ({16: 4, 24: 6}[bits] << 1), 0]) + (n - 1).to_bytes(2, "big")
    head += bytes([flac.crc8(head)])
    text = "".join("00000010" + "".join(format(int(v) & ((1 << w) - 1), f"0{w}b") for v in x) for x, w in zip((a, b), widths, strict=True))
    text += "0" * (-len(text) % 8)
    frame = head + int(text, 2).to_bytes(len(text) // 8, "big")
    frame += int(flac.crc16(np.frombuffer(frame, np.uint8), np.array([0]), np.array([len(frame)]))[0]).to_bytes(2, "big")
    pcm = flac.pcm_bytes(np.stack([left, right], 1), bits)
    packed = (44100 << 44) | (1 << 41) | ((bits - 1) << 36) | n
    info = n.to_bytes(2, "big") * 2 + bytes(6) + packed.to_bytes(8, "big") + hashlib.md5(pcm).digest()
    return b"fLaC\x80" + len(info).to_bytes(3, "big") + info + frame


def test_flac_reads_joint_stereo_and_wide_samples():
    r = np.random.RandomState(7)
    for bits in (16, 24):
        left, right = (r.randint(-(1 << (bits - 1)), 1 << (bits - 1), 300) for _ in range(2))
        for joint in (0, 8, 9, 10):
            (_, (block,)), = flac.decode_streams([stereo_stream(left, right, joint, bits)])
            assert (block[:, 0] == left).all() and (block[:, 1] == right).all()


def test_flac_any_damage_is_an_error(spark):
    r = random.Random(1)
    whole = [flac.encode_payloads([flac.payload_of(words(200, 3))])[0], stereo_stream(np.arange(50), np.arange(50)[::-1], 10, 16)]
    for _ in range(300):
        hurt = bytearray(r.choice(whole))
        for _ in range(r.randint(1, 3)):
            hurt[r.randrange(4, len(hurt))] = r.randrange(256)
        hurt = bytes(hurt[: r.choice([len(hurt), r.randrange(len(hurt))])])
        try:
            flac.decode_streams([hurt])
        except flac.FlacError:
            pass
    with pytest.raises(flac.FlacError):
        flac.decode_streams([b"fLaC\x80\x00\x00\x04\x00\x00\x00\x00"])
    d = spark.createDataFrame([(1, bytearray(whole[0])), (2, bytearray(whole[0][:60])), (3, None)], "doc_id long, media binary")
    got = {r["doc_id"]: r["error"] for r in flac.decode_blocks(d).select("doc_id", "error").distinct().collect()}
    assert got[1] is None and got[2] and got[3]
    noise = bytes(r.randrange(256) for _ in range(1 << 18))
    stream = flac.encode_payloads([noise])[0]
    (_, blocks), = flac.decode_streams([stream])
    assert (np.concatenate(blocks)[:, 0] + 128).astype(np.uint8).tobytes() == noise


def test_dedup_against_stored_snapshots(spark, tmp_path, monkeypatch):
    """Two snapshots written once and opened again; a batch many times a bucket's size."""
    monkeypatch.setattr(exact_dedup, "BUCKET_KEYS", 8)
    old, new = [words(9, i) for i in range(40)], [words(9, 30 + i) for i in range(40)]
    first, second = corpus(spark, old + old[:5]), corpus(spark, new, list(range(100, 140)))
    exact_dedup.write_snapshot(first, str(tmp_path / "a"))
    exact_dedup.write_snapshot(second, str(tmp_path / "b"))
    snapshots = [exact_dedup.open_snapshot(str(tmp_path / "a"), first), exact_dedup.open_snapshot(str(tmp_path / "b"), second)]
    assert snapshots[0].buckets == 5 and snapshots[0].filters.count() == 5
    texts = [words(9, i) for i in range(20, 200)] + [None, "", words(9, 2)]
    ids = list(range(50, 50 + len(texts)))
    got = {r["doc_id"]: r for r in exact_dedup.dedup_against(corpus(spark, texts, ids), snapshots).collect()}
    every = [(i, t or "") for i, t in zip(ids, texts, strict=True)] + list(enumerate(old + old[:5])) + list(zip(range(100, 140), new, strict=True))
    seen = {*old, *new}
    for i, t in zip(ids, texts, strict=True):
        same = [k for k, x in every if x == (t or "")]
        r = got[i]
        assert (r["keep_id"], r["group_size"], r["known"]) == (max(same), len(same), (t or "") in seen)
        assert r["kept"] <= (i == max(same))


def test_newton_forms_agree_and_are_the_dual_optimum(spark, monkeypatch):
    r = random.Random(12)
    texts = [words(r.randint(1, 50), i) for i in range(300)]
    d = corpus(spark, texts, sources=[r.choice(["a", "b", "b", "c", None]) for _ in texts])
    held = {x["doc_id"]: (x["rate"], x["copies"]) for x in mixing.mix(d).collect()}
    monkeypatch.setattr(mixing, "HELD_SOURCES", 0)
    got = mixing.mix(d).collect()
    for x in got:
        assert math.isclose(held[x["doc_id"]][0], x["rate"], rel_tol=1e-9) and held[x["doc_id"]][1] == x["copies"]
    by = {}
    for x in got:
        by.setdefault(x["source"], []).append(x)
    for rows in by.values():
        # Rates meet the target, and their log odds are in proportion to sizes: the optimality conditions of the dual.
        assert math.isclose(sum(x["rate"] * x["size"] for x in rows), rows[0]["target"], rel_tol=1e-6)
        tilts = [math.log(x["rate"] / (2 - x["rate"])) / x["size"] for x in rows if 0 < x["rate"] < 2]
        assert not tilts or max(tilts) - min(tilts) < 1e-6 * max(1, abs(tilts[0]))
