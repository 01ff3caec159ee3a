"""Encoding, mixing, names and abuse: exact round trips, small truths and edge cases."""

import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinscope.llm import abuse, names, tokens
from kinscope.llm.mixing import mix
from kinscope.llm.names import radius_join, same_names, words_of

needs_vocabulary = pytest.mark.skipif(not os.path.isdir(tokens.VOCABULARIES), reason="no vocabularies")


@pytest.fixture(scope="module")
def bpe():
    return tokens.ByteBpe(os.path.join(tokens.VOCABULARIES, tokens.BYTE_BPE_50K))


TRICKY = ["", " ", "\n\n", "a", "  two  spaces ", "it's we'll THEY'VE", "<|endoftext|> is text", "tabs\tand\r\nlines", "naïve Ünïcode 你好 мир 🧪👩‍💻", "1234567 89", "x" * 9_000, "ab1" * 5_000, " " * 9_000 + "end", "é" * 5_000, "🧪" * 3_000]


@needs_vocabulary
@pytest.mark.parametrize("text", TRICKY, ids=range(len(TRICKY)))
def test_encoding_equals_the_other_library(bpe, text):
    from tokenizers import Tokenizer

    other = Tokenizer.from_file(os.path.join(tokens.VOCABULARIES, "byte_bpe_50k.json"))
    other.encode_special_tokens = True
    got = bpe.encode(text)
    assert got == other.encode(text, add_special_tokens=False).ids
    assert b"".join(bpe.bytes_of[i] for i in got).decode() == text


@needs_vocabulary
def test_tree_concatenation_equals_one_encoding(bpe):
    rng = random.Random(1)
    for alphabet in ("ab", "abcdefghijklmnopqrstuvwxyz", "aeinrst", "01", "=-", "äöüß"):
        data = "".join(rng.choice(alphabet) for _ in range(6_000)).encode()
        for limit in (7, 64, 1_000):
            assert bpe.piece(data, limit) == bpe.core._encode_single_piece(data)


@needs_vocabulary
def test_chunks_follow_each_other(bpe):
    rng = random.Random(2)
    text = "".join(rng.choice(["word", " ", "  ", "\n", "\t", "it's", "42", ".", "é", "!?"]) for _ in range(4_000))
    parts = tokens._chunks(text, 50)
    assert len(parts) > 20 and "".join(parts) == text
    assert [i for p in parts for i in bpe.encode(p)] == bpe.encode(text)


@needs_vocabulary
def test_encode_table(spark, bpe):
    long = "some words and more, " * 400
    rows = [(1, "plain"), (2, None), (3, ""), (4, long), (4, long), (5, "y" * 3_000), (None, "no id"), (None, long)]
    df = spark.createDataFrame([(i, t, "clash", 0) for i, t in rows], "doc_id bigint, text string, ids string, part int")
    got = sorted(((r["doc_id"], r["ids"]) for r in tokens.encode(df, "doc_id", "text", chunk_chars=1_000).collect()), key=str)
    assert got == sorted(((i, bpe.encode(t)) for i, t in rows), key=str)
    assert tokens.encode(df.limit(0), "doc_id", "text").count() == 0
    counts = {r["doc_id"]: r["tokens"] for r in tokens.token_counts(df, ["doc_id"], "text").collect()}
    assert counts[2] == counts[3] == 0 and counts[4] == len(bpe.encode(long))


def documents(spark, sizes, seed=0):
    rng = random.Random(seed)
    rows = [(i, s, rng.randint(20, 400), "clash") for i, s in enumerate(s for s, n in sizes.items() for _ in range(n))]
    return spark.createDataFrame(rows, "doc_id bigint, source string, tokens bigint, u string")


def test_mix_reaches_shares_within_caps(spark):
    docs = documents(spark, {"a": 900, "b": 300, "c": 40, "other": 50})
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.3, 2), ("c", 0.1, 4), ("absent", 0.1, 2)], "source string, target_share double, max_repeats int")
    draws, report = mix(docs, targets)
    rows = {r["source"]: r for r in report.collect()}
    for s, share in (("a", 0.5), ("b", 0.3), ("c", 0.1)):
        assert rows[s]["share_reached"] == pytest.approx(share / 0.9, abs=0.01)
        assert rows[s]["most_repeats"] <= rows[s]["max_repeats"]
    assert rows["other"]["tokens_used"] == rows["absent"]["documents"] == 0
    used = draws.groupBy("doc_id").agg(F.max("copy").alias("m"), F.count(F.lit(1)).alias("n")).collect()
    assert all(r["m"] == r["n"] for r in used)
    size = {r["doc_id"]: r["tokens"] for r in docs.collect()}
    assert sum(size[r["doc_id"]] * r["n"] for r in used) == sum(r["tokens_used"] for r in rows.values())
    again = mix(docs, targets)[0]
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, draws.collect()))


def test_mix_edge_cases(spark):
    targets = spark.createDataFrame([("a", 0.5, 1), (None, 0.2, 1), ("b", None, 1), ("c", 0.3, None), ("d", 0.0, 3)], "source string, target_share double, max_repeats int")
    docs = spark.createDataFrame([(1, "a", 10), (2, "a", None), (3, None, 5), (4, "b", 5), (5, "d", 5), (6, "a", 0)], "doc_id bigint, source string, tokens bigint")
    draws, report = mix(docs, targets)
    assert {r["doc_id"] for r in draws.collect()} == {1} and report.where("source = 'a'").first()["share_reached"] == 1.0
    draws, report = mix(docs.limit(0), targets)
    assert draws.count() == 0 and report.where("tokens_used > 0").count() == 0


def test_words_of_names():
    assert words_of("The Gärtor-RAVENS  Group") == (None, ["gartor", "ravens"])
    assert words_of("GartorbacruRaven") == (None, ["gartorbacru", "raven"])
    assert words_of("Katya T4lv3nlopim") == (None, ["katya", "talvenlopim"])
    assert words_of("VLN-1000130") == words_of("vln 1000130") == ("vln1000130", [])
    assert words_of("Unknown") == words_of("cluster-12") == (None, [])


def test_distances_are_true_edit_distances():
    from functools import cache

    @cache
    def lev(a, b):
        if not a or not b:
            return len(a) + len(b)
        return min(lev(a[1:], b) + 1, lev(a, b[1:]) + 1, lev(a[1:], b[1:]) + (a[0] != b[0]))

    rng = random.Random(3)
    words = ["".join(rng.choice("abc") for _ in range(rng.randint(0, 8))) for _ in range(40)]
    for p in words[:12]:
        assert names.distances(words, p).tolist() == [lev(w, p) for w in words]
    chars, size = names.letters(words)
    a, b = np.divmod(np.arange(len(words) ** 2), len(words))
    assert names.pair_distances(chars, size, a, b).tolist() == [lev(words[i], words[j]) for i, j in zip(a, b)]


def near(a, b):
    chars, size = names.letters([a, b])
    return names.pair_distances(chars, size, np.array([0]), np.array([1]))[0] <= (2 if min(len(a), len(b)) >= 7 else 1)


@pytest.mark.parametrize("cell_rows", [5_000, 20])
def test_radius_join_equals_brute_force(spark, cell_rows, monkeypatch):
    rng = random.Random(5)
    stems = {"".join(rng.choice(["tal", "gor", "mi", "bel", "zu"]) for _ in range(4)) for _ in range(120)}
    stems |= {s[:i] + s[i + 1 :] for s in list(stems)[:40] for i in (3,)} | {s[:4] + s[5] + s[4] + s[6:] for s in list(stems)[:40] if len(s) > 7}
    stems = sorted(stems)
    guests = set(stems[::5])
    df = spark.createDataFrame([("x", s, s in guests) for s in stems] + [("y", stems[0], False)], "anchor string, stem string, guest boolean")
    monkeypatch.setattr(names, "CHUNK_ROWS", 50)
    found = radius_join(df, cell_rows=cell_rows).collect()
    got = {tuple(sorted((r["x"], r["y"]))) for r in found}
    assert len(got) == len(found) and all(r["guest"] == (r["x"] in guests) and r["y"] not in guests for r in found)
    assert got == {(a, b) for i, a in enumerate(stems) for b in stems[i + 1 :] if near(a, b) and not {a, b} <= guests}


def people(spark, rows):
    return spark.createDataFrame([(i, n, a, "clash", 0) for i, n, a in rows], "id string, name string, aliases array<string>, form string, node int")


def test_variants_meet_and_generic_names_do_not(spark):
    filler = [(f"Z{i:03}", f"{a} {s}", None) for i, (a, s) in enumerate((a, s) for a in ("Raven", "Heron", "Margaret") for s in ("Talgorbel", "Zumibelgor", "Kipnallazu", "Ostvenlomi", "Fendrarilca", "Quenmardov"))]
    rows = [
        ("A1", "Hekseveznal Raven", None), ("A2", "RAVENS HEKSEVEZAL", []), ("A3", "HekseveznalRaven", [None, ""]), ("A4", "the Hekseveznal-Raven group", None), ("A1", "Hekseveznal Raven", None),
        ("B1", "Margaret Hekseveznal", None), ("B2", "Peggy Hekseveznal", None), ("B3", "Unknown", ["H3ks3v3znal, Margaret"]),
        ("C1", "Lolathpelquen Heron", ["OBR-1000003"]), ("C2", "X1", ["obr1000003"]), ("C3", "Unknown", None), ("C4", None, None), ("C5", "Unknown", ["  "]),
        ("D1", "M. Ostvenlomi", None), *filler,
    ]
    members, forms = same_names(people(spark, rows), "id", "name", "aliases")
    group = {r["key"]: r["group"] for r in members.collect()}
    assert {group[k] for k in ("A1", "A2", "A3", "A4")} == {"A1"} and {group[k] for k in ("B1", "B2", "B3")} == {"B1"} and group["C1"] == group["C2"] == "C1"
    assert not {"C3", "C4", "C5"} & set(group)
    assert group["D1"] == group[next(i for i, n, _ in filler if n == "Margaret Ostvenlomi")]
    assert forms.where("key = 'A3'").count() == 1
    none = same_names(people(spark, []), "id", "name", "aliases")[0]
    assert none.count() == 0


def test_short_forms_are_learnt_and_slips_visit_all_their_anchors(spark):
    made = ["Talgorbel", "Zumibelgor", "Kipnallazu", "Ostvenlomi", "Fendrarilca", "Quenmardov"]
    rows = [(f"Z{i:03}", f"{a} {s}", None) for i, (a, s) in enumerate((a, s) for a in ("Ekaterina", "Katya", "Marlin", "Martin", "Gazelle") for s in made)]
    # Beside three stems one record has both forms, one of them by a shared code.
    rows += [("L1", "Ekaterina Bahurilzu", ["Katya Bahurilzu"]), ("L2", "Ekaterina Sevtaldru", ["Sevtaldru, Katya"]), ("L3", "Ekaterina Jasnixgro", ["AB-10001"]), ("L4", "Katya Jasnixgro", ["ab 10001"])]
    rows += [("E1", "Katya Pelkorlathim", None), ("E2", "Ekaterina Pelkorlathim", None)]
    # Marlin comes first for "marin"; only Martin knows the stem.
    rows += [("M1", "Marin Hekdovrilta", None), ("M2", "Martin Hekdovrilta", None), ("N1", "Gazelle Hekdovrilta", None)]
    for times in (1, 40):
        more = [(f"{k}/{n}" if n else k, v, a) for n in range(times) for k, v, a in rows]
        group = {r["key"]: r["group"] for r in same_names(people(spark, more), "id", "name", "aliases", short_forms={})[0].collect()}
        assert group["E1"] == group["E2"] == "E1" and group["M1"] == group["M2"] == "M1" and group["N1"] == "N1"


def texts():
    rng = random.Random(6)
    neutral = ["The loader writes {} to disk.", "Coverage was {} percent.", "Two aliases were merged after {} reviews.", "Refugees and women were among the {} victims.", "Bloody awful logs, but great work by {}."]
    bad = ["You are a worthless idiot and everyone knows it {}.", "Women are vermin and should be driven out {}.", "Refugees are vermin and should be driven out {}.", "I will break every bone you have {}."]
    out = []
    for i in range(400):
        lines = [rng.choice(neutral).format(rng.randint(1, 99)) for _ in range(rng.randint(1, 6))]
        label = int(i % 4 == 0)
        if label:
            lines.insert(rng.randrange(len(lines) + 1), rng.choice(bad).format(rng.randint(1, 9)))
        if i % 37 == 0:
            label = 1 - label
            out.append(("\n".join(lines), label, 1 - label))
        else:
            out.append(("\n".join(lines), label, label))
    return out


def test_disguises_are_undone():
    assert abuse.plain("You d i p s h i t") == "you dipshit" and abuse.plain("t.u.r.d") == "turd" and abuse.plain("1d10t") == "idiot"
    assert abuse.plain("sc​um Ünï") == "scum uni" and abuse.plain("diiiimwit") == "dimwit" and abuse.plain("іdіоt") == "idiot"


def test_classifier_learns_from_noisy_labels():
    rows = texts()
    model = abuse.train([t for t, _, _ in rows[:300]], [float(y) for _, y, _ in rows[:300]])
    right = [(model.document(t) >= model.threshold) == bool(y) for t, _, y in rows[300:]]
    assert np.mean(right) >= 0.97
    assert model.document(None) == model.document("") == 0.0


def test_group_words_do_not_decide():
    rows = texts()
    model = abuse.train([t for t, _, _ in rows], [float(y) for _, y, _ in rows])
    score = model.document
    neutral = [score(f"{g} were among the 7 victims.") for g in ("Women", "Refugees", "Foreigners", "Muslims")]
    assert max(neutral) < model.threshold
    assert score("Foreigners are vermin and should be driven out 3.") >= model.threshold


def test_classifier_tables(spark):
    rows = texts()
    docs = spark.createDataFrame([(i, t, "s", 0.0) for i, (t, _, _) in enumerate(rows)] + [(900, None, "s", 0.0), (901, "", None, 0.0), (902, "x" * 50_000, "s", 0.0)], "doc_id bigint, text string, source string, score double")
    labels = spark.createDataFrame([(i, y) for i, (_, y, _) in enumerate(rows)] + [(5, None), (77_777, 1), (None, 1)], "doc_id bigint, abusive int")
    scored = abuse.score(docs, abuse.fit(docs, labels), ["doc_id", "source"], "text")
    got = {r["doc_id"]: r["abusive"] for r in scored.collect()}
    assert len(got) == 403 and not got[900] and not got[901] and not got[902]
    assert np.mean([got[i] == bool(y) for i, (_, _, y) in enumerate(rows)]) >= 0.97
    bare = abuse.fit(docs, labels.limit(0))
    # Nothing to learn from: nothing is scored, the list of strong words alone decides nothing.
    assert abuse.score(docs, bare, ["doc_id"], "text").where("score is null and abusive is null").count() == 403
    assert abuse.score(docs.limit(0), bare, ["doc_id"], "text").count() == 0
    assert abuse.score(docs.limit(0), abuse.fit(docs, labels), ["doc_id"], "text").count() == 0


def test_scores_do_not_depend_on_the_texts_read_together(monkeypatch):
    rows = texts()
    model = abuse.train([t for t, _, _ in rows], [float(y) for _, y, _ in rows])
    together = model.documents([t for t, _, _ in rows] + [None, "", " \n\x01\n "])
    monkeypatch.setattr(abuse, "CHARS", 500)
    assert np.allclose(model.documents([t for t, _, _ in rows] + [None, "", " \n\x01\n "]), together)
    assert np.allclose([model.document(t) for t, _, _ in rows[:40]], together[:40]) and not together[-3:].any()


def spelled(text):
    u = abuse.Units.read([text])
    return [" ".join(u.words[t] for t in u.token[b:e]) for b, e, s in zip(u.begin, u.end, u.single) if s], [" ".join(u.words[t] for t in u.token[b:e]) for b, e, s in zip(u.begin, u.end, u.single) if not s]


def test_an_insult_in_a_dump_counts_as_much_as_alone():
    weight = np.zeros(abuse.DIMS, np.float32)
    weight[abuse.features(["bastard"])] = 8
    model = abuse.Classifier(weight, abuse.BIAS)
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("bdfglmnprstv") + rng.choice("aeio") for _ in range(3))
    fields = [f'"note": "{" ".join(word() for _ in range(12))}."' for _ in range(40)]
    assert model.document("you bastard") > 0.5
    for insult in ('"note": "you bastard"', '"note": "you bastard."', '"note": "fine.\\nyou bastard\\nfine"'):
        dump = "{" + ", ".join([*fields[:20], insult, *fields[20:]]) + "}"
        assert model.document(dump) > 0.5
    assert model.document("{" + ", ".join(fields) + "}") < 0.3
    before, after = (" ".join(word() for _ in range(300)) for _ in range(2))
    assert model.document(f"{before} you bastard {after}") > 1.5 * model.document(before) + 0.05
    assert spelled("you are\na bastard") == (["you are", "a bastard"], ["you are a bastard"])


def test_windows_cover_a_long_unit():
    for n in (1, 30, 31, 36, 37, 400):
        words = [chr(97 + i // 26) + chr(97 + i % 26) + "x" for i in range(n)]
        got = [w.split() for w in spelled(" ".join(words))[0]]
        assert all(len(w) <= abuse.LONG for w in got)
        for i in range(max(1, n - abuse.SPAN // 2)):
            run = words[i : i + abuse.SPAN // 2]
            assert any(w[j : j + len(run)] == run for w in got for j in range(len(w)))
