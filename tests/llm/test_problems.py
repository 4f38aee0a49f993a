"""The language operators: nulls, empty and very long texts, ties, repeated rows, empty tables,
clashing extra columns, and brute-force or round-trip checks."""

import datetime as dt
import itertools
import json
import math
import random

import pytest
from pyspark.sql import functions as F

pytest.importorskip("gneiss.llm.text")
from gneiss.llm import conversations, lookalikes, mixing, packing, pairs, pieces, quantiles, scans, subjects, tokens  # noqa: E402
from gneiss.llm.text import language, look  # noqa: E402

T0 = dt.datetime(2031, 1, 1)


# ---------------------------------------------------------------- 2 scans
BODY = ["In practice, the disciplinary board hears the student before a warning is recorded.", "A certificate of foreign language at level B1 is needed before graduation of the class."]


def scan(spark, chunks):
    rows = [(c, "doc", float(p), float(p), None, t) for c, p, t in chunks]
    return spark.createDataFrame(rows, "chunk_id string, doc_id string, lo double, hi double, heading_path array<string>, content string")


def test_scan_damage_is_found_and_repaired(spark):
    chunks = [(f"c{i}", i, f"North College, Student Guide\n{["Red", "Blue", "Green", "Grey", "Pink", "White"][i - 1]} groups know that the disci-\nplinary board hears thc student before a warn1ng is\nrecorded. Every long-\nterm plan counts for something here too.\n\n4711\n\nMore text follows here.\nPage {i}") for i in range(1, 7)]
    clean = [(f"k{i}", 50 + i, " ".join(BODY) + " Every long-term plan counts for something here too. More text follows here.") for i in range(3)]
    d = scans.described_chunks(scan(spark, chunks + clean + [("e", 90, "")])).cache()
    model = scans.train(d)
    found = scans.repairs(scans.findings(d, model)).where("chunk_id = 'c3'").select("kind", "value").distinct()
    got = {(r["kind"], r["value"]) for r in found.collect()}
    assert ("running_line", "North College, Student Guide") in got and ("page_number", "Page 3") in got
    assert {("broken_word", "disciplinary"), ("broken_word", "long-term"), ("misread", "the"), ("misread", "warning")} <= got
    assert not any(v == "4711" for _, v in got)
    text = " ".join(r["text"] for r in scans.repaired_paragraphs(scans.repairs(scans.findings(d, model)), d, model).where("chunk_id = 'c3'").orderBy("paragraph").collect())
    assert "the disciplinary board hears the student before a warning is recorded. Every long-term plan" in text and "North College" not in text


def test_running_lines_and_offsets_of_chapters(spark):
    """Chapters with their own header, and their own numbering, in one document of many chunks."""
    r = random.Random(3)
    word = lambda: "".join(r.choice("bdgklmnprst") + r.choice("aeiou") for _ in range(3))
    body = lambda: "\n".join(" ".join(word() for _ in range(9)) for _ in range(8))
    chunks = []
    for c, name in enumerate(["Red", "Blue", "Green", "Grey", "Pink", "White", "Black", "Brown", "Gold", "Tan", "Teal", "Plum"]):
        chunks += [(f"{name}{i}", 100 * c + i, f"{name} Chapter of the Guide\n{body()}\n{100 * c + i - 3 * c}") for i in range(1, 13)]
    d = scans.described_chunks(scan(spark, chunks))
    found = {(x["chunk_id"], x["kind"], x["value"]) for x in scans.repairs(scans.findings(d, scans.train(d))).where("kind in ('running_line', 'page_number')").collect()}
    want = {(c, "running_line", t.split("\n")[0]) for c, _, t in chunks} | {(c, "page_number", t.split("\n")[-1]) for c, _, t in chunks}
    assert len(want & found) >= 0.97 * len(want) and not found - want


def test_short_and_pointed_running_lines_and_long_ones(spark):
    r = random.Random(4)
    body = lambda: "\n".join(" ".join("".join(r.choice("bdgklmnprst") + r.choice("aeiou") for _ in range(3)) for _ in range(9)) for _ in range(8))
    for line in ("BIO", "St. Mary's Univ.", "A very long title " * 20 + "ends"):
        d = scans.described_chunks(scan(spark, [(f"c{i}", i, f"{line}\n{body()}") for i in range(1, 13)]))
        found = scans.repairs(scans.findings(d, scans.train(d))).where("kind = 'running_line'").collect()
        assert len(found) == 12 and {x["value"] for x in found} == {line.strip()}
    assert scans.number_line("." * 50_000 + " 12 " + "-" * 50_000) == ("arabic", 12, True)


def test_scan_of_nothing_and_of_long_lines(spark):
    d = scans.described_chunks(scan(spark, []))
    assert scans.repairs(scans.findings(d, scans.train(d))).count() == 0
    d = scans.described_chunks(scan(spark, [("x", 1, "a" * 200_000), ("y", 2, " " * 50_000 + "." * 50_000)]))
    assert scans.repairs(scans.findings(d, scans.train(d))).count() == 0


@pytest.mark.parametrize("line,got", [("- 2 -", ("arabic", 2, True)), ("Page iv", ("roman", 4, True)), ("29 / 212", ("arabic", 29, True)), ("18.", None), ("week 9", None), ("", None)])
def test_number_lines(line, got):
    assert scans.number_line(line) == got


# ---------------------------------------------------------------- 3 pairs
def inspect(q, a):
    return pairs.inspect(q, a)


@pytest.mark.parametrize("answer", [None, "", "  \n", "​", "N/A", "{}", "<answer></answer>", "—", "[L2]", "null"])
def test_empty_answers(answer):
    assert inspect("How is AB assessed?", answer) == "empty"


@pytest.mark.parametrize("question", ["Why?", "Fee 9?", "Quand ?", "Ai?", "x"])
def test_short_questions_are_copied_too(question):
    assert inspect(question, question) == inspect(question, f"You asked: {question}") == inspect(question, f"{question} {question}") == "copies_question"
    assert inspect(question, "The fee is 12.") != "copies_question"


def test_copies_of_repetitive_questions():
    # an answer much shorter than the question that still gives all of it back
    assert inspect("go on and on and on and on and on", "on and on and on and on and go on and on") == "copies_question"
    assert not pairs.copies("?!", "?!") and not pairs.copies("", "")


def test_lossless_screen_of_copies():
    rnd = random.Random(5)
    words = ["ab", "abc", "b", "ca", "cab"]
    for _ in range(400):
        q, a = (" ".join(rnd.choice(words) for _ in range(rnd.randint(1, 6))) for _ in range(2))
        least = min(10, len(q))
        hit = pairs.SuffixAutomaton(f" {q} ").covered(f" {a} ", least)
        if all(h for h, ch in zip(hit, f" {a} ") if ch != " "):
            assert pairs._may_copy(f" {a} ", f" {q} ", least)


def test_refusal_grammar():
    from refusal_phrases import ANSWERS, FIFTH, FOURTH, REFUSALS, SECOND, THIRD, UNSEEN

    assert all(pairs.refuses(a) for some in REFUSALS.values() for a in some) and all(pairs.refuses(a) for a in SECOND + THIRD + FOURTH + FIFTH)
    assert not any(pairs.refuses(a) for some in ANSWERS.values() for a in some)
    assert sum(pairs.refuses(a) for a in UNSEEN) >= 0.9 * len(UNSEEN)
    assert not pairs.refuses("") and not pairs.refuses("word " * 200_000)


def test_copies_refusals_languages():
    q = "Which courses must be passed before KFFN6545?"
    assert inspect(q, q) == inspect(q, "You asked: " + q) == inspect(q, q + "\n" + q) == inspect(q, "WHICH COURSES MUST BE PASSED BEFORE KFFN6545") == "copies_question"
    assert inspect(q, q + " Students must pass AAAA1111 before they enrol.") is None
    for a in ("I'm sorry, but I can't help with that.", "Tôi không được phép bàn về nội dung này.", "Les documents choisis ne permettent pas de répondre.", "There is nothing in the evidence that settles the matter."):
        assert inspect("x", a) == "refusal"
    for a in ("You cannot take it twice in one semester.", "I can't stress this enough: it needs 9 credits.", "Sorry for the long text: students who cannot attend must tell the office.", "Sinh viên không thể học hai lần trong một học kỳ."):
        assert inspect(None, a) is None
    assert inspect(q, "Sinh viên phải hoàn thành AAAA1111 trước khi đăng ký.") == "wrong_language"
    assert inspect("Please answer in Vietnamese: " + q, "Sinh viên phải hoàn thành AAAA1111 trước khi đăng ký.") is None
    assert inspect(q, "Students must pass it (see also") == inspect(q, "The rule reads: \"The student") == inspect(q, "It is so.\n2.") == "truncated"


def test_truncation_by_statistics(spark):
    whole = "The library card is valid until the end of the year."
    rows = [(f"r{i}", "When is the card valid?", whole) for i in range(5)] + [("cut", "When is the card valid?", "The library card is valid until the"), ("bare", "When is the card valid?", whole.rstrip(".")), ("null", None, None)]
    got = {r["request_id"]: r["defect"] for r in pairs.defects(spark.createDataFrame(rows, "request_id string, question string, answer string")).collect()}
    assert got == {"cut": "truncated", "null": "empty"}


def test_suffix_automaton_against_brute_force():
    r = random.Random(2)
    for _ in range(60):
        a, b, k = "".join(r.choice("ab") for _ in range(14)), "".join(r.choice("abc") for _ in range(18)), r.randint(1, 4)
        want = [any(b[i:j] in a for i in range(x + 1) for j in range(max(x + 1, i + k), len(b) + 1)) for x in range(len(b))]
        assert pairs.SuffixAutomaton(a).covered(b, k) == want


# ---------------------------------------------------------------- 4 look-alikes
def test_look_keeps_what_looks_different():
    assert look("Khóa") == look("Khóa") and look("ﬁnd") == look("find") and look("a　b ") == look("a b") and look("part‐time") == look("part-time") and look("ex­am") == look("exam")
    assert look("m²") != look("m2") and look("½") != look("1/2") and look("Ab") != look("ab") and look("hoc") != look("học")


def test_pairs_of_one_look(spark):
    rows = [("a", "When does XHAB1234 close?"), ("b", "When does ХНАВ1234 close?"), ("c", "When​ does XHAB1234 close? "), ("d", "When does XHAB1234 close?"), ("e", "when does XHAB1234 close?"), ("f", "Where is α?"), ("g", "Where is a?"), ("h", None), (None, "x"), ("a", "When does XHAB1234 close?")]
    assert pairs_of(spark, rows) == {("a", "b"), ("a", "c"), ("b", "c"), ("b", "d"), ("c", "d")}
    assert pairs_of(spark, []) == set()


def pairs_of(spark, rows):
    d = spark.createDataFrame([("t", *r) for r in rows], "source string, key string, text string")
    return {(r["key_a"], r["key_b"]) for r in lookalikes.look_alike_pairs(d, "source").collect()}


def test_pairs_of_other_scripts(spark):
    """Towards the script that dominates a token, whatever it is."""
    there = "Где находится библиотека"
    latin = there.replace("о", "o").replace("а", "a").replace("х", "x").replace("с", "c")
    assert latin != there
    greek = "Που βρίσκεται το ΒΙΒΛΙΟ"
    rows = [("a", there), ("b", latin), ("c", there.replace("е", "e")), ("d", "Где стоит библиотека"), ("e", greek), ("f", greek.replace("ΒΙΒΛΙΟ", "BΙBΛIO")), ("g", "The copy is here"), ("h", "The сорy is here"), ("i", "The сору is here")]
    assert pairs_of(spark, rows) == {("a", "b"), ("a", "c"), ("b", "c"), ("e", "f"), ("g", "h"), ("g", "i"), ("h", "i")}


def test_pairs_of_a_hot_class(spark, monkeypatch):
    monkeypatch.setattr(lookalikes, "CLASS_PART", 7)
    rows = [(f"k{i:03}", "one text" if i % 3 else "one\u00a0text") for i in range(60)]
    want = {(a, b) for a, x in rows for b, y in rows if a < b and x != y}
    assert pairs_of(spark, rows) == want


def test_unattested_repairs_are_left_alone(spark):
    rows = [("a", "the сode qzхw here"), ("b", "code here")]
    got = {r["key"]: r["form"] for r in lookalikes.one_form(spark.createDataFrame(rows, "key string, text string")).collect()}
    assert got["a"] == "the code qzхw here"


# ---------------------------------------------------------------- 5 pieces
@pytest.mark.parametrize("seed", range(5))
def test_pieces_cover_the_text(seed):
    r = random.Random(seed)
    text = "".join(r.choice(["word ", "Sentence end. ", "\n\n", "\f", "x" * r.randint(1, 400) + " "]) for _ in range(r.randint(50, 400)))
    level, cut = pieces.split(text)
    at = 0
    for begin, fresh, end in cut:
        assert end - begin <= 2400 and 0 <= fresh - begin <= 240 and end > fresh and not text[at:fresh].strip()
        at = end
    assert not text[at:].strip() and level in ("whole", "paragraph", "sentence", "word", "none")


def test_boundaries_and_edits():
    assert pieces.boundary_of("a" * 2401) == "none" and pieces.boundary_of(("a" * 1200 + " ") * 3) == "word" and pieces.boundary_of(("b" * 1300 + ". ") * 3) == "sentence" and pieces.boundary_of(("c" * 2400 + "\n\n") * 2) == "paragraph"
    r = random.Random(1)
    text = " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(2, 9))) + "." * (r.random() < 0.15) for _ in range(8000))
    fresh = lambda t: {t[f:e] for _, f, e in pieces.split(t)[1]}
    a, b = fresh(text), fresh(text[:9000] + " inserted words. " + text[9000:])
    assert len(a - b) <= 3


def test_items_with_nulls_and_clashing_columns(spark):
    d = spark.createDataFrame([("k", "a" * 5000, 1, 2), ("k", "a" * 5000, 1, 2), ("n", None, 1, 2), ("e", "", 1, 2)], "chunk_id string, content string, piece int, text int")
    got = pieces.split_items(d, "chunk_id", "content")
    assert got.where("chunk_id = 'k'").count() == 3 and got.where("chunk_id = 'e'").count() == 1 and got.where("chunk_id = 'n'").count() == 0
    places = spark.createDataFrame([("k", ["H"], [9, 7], 7)], "chunk_id string, heading_path array<string>, page_range array<int>, page int")
    at = pieces.located(got, places).where("chunk_id = 'k'").orderBy("piece").collect()
    assert at[0]["page_from"] == 7 and at[-1]["page_to"] == 9 and at[0]["heading_path"] == ["H"]


# ---------------------------------------------------------------- 6 quantiles
def test_quantiles_merge_within_bounds(spark):
    r = random.Random(4)
    rows = [("hot", f"k{i}", r.lognormvariate(0, 1), i % 7) for i in range(30_000)] + [("small", "a", 1.0, 0), ("small", "b", 3.0, 1), ("small", "b", 3.0, 1), ("bad", "x", math.nan, 0), ("bad", "y", -1.0, 0), ("bad", "z", None, 0), ("bad", "w", math.inf, 0)]
    d = spark.createDataFrame(rows, "g string, key string, v double, day int")
    u = quantiles.usable(d, [F.col("g"), F.col("day")], [F.col("key")], F.col("v"))
    got = {(x["g"], x["pct"]): (x["n"], x["value"]) for x in quantiles.percentiles(quantiles.merge(quantiles.sketch(u, ["g", "day"], k=512), ["g"], k=512), ["g"]).collect()}
    values = sorted(x[2] for x in rows if x[0] == "hot")
    for p in (50, 95, 99):
        n, v = got["hot", p]
        rank = sum(x <= v for x in values) / len(values)
        assert n == 30_000 and abs(rank - p / 100) < 0.015
    assert got["small", 50] == (2, 1.0) and got["small", 99] == (2, 3.0) and ("bad", 50) not in got
    assert quantiles.sketch(u.where("false"), ["g"]).count() == 0


# ---------------------------------------------------------------- 7 conversations
def turn(case, n, q, a, history, digest=None, at=T0, status="completed"):
    req = json.dumps({"question": q, "history": [{"role": "user", "content": c} for c in history]})
    res = None if a is None else json.dumps({"answer": {"answer": a}})
    return (digest or f"{case}{n}", case, n, req, status, res, at)


ATTEMPT = "digest string, case_id string, turn int, request string, status string, response string, recorded_at timestamp_ntz"


def test_conversations(spark):
    rows = [
        turn("good", 0, "q0", "a0", []), turn("good", 1, "q1", "a1", ["q0", "a0"]), turn("good", 1, "q1", None, ["q0", "a0"], at=T0 - dt.timedelta(days=1)),
        turn("good", 0, "q0", "a0", []),
        turn("silent", 0, "q0", None, []), turn("silent", 1, "q1", "a1", []),
        turn("blank", 0, "q0", " ​", []), turn("gap", 0, "q", "a", []), turn("gap", 2, "q2", "a2", ["q", "a"]),
        turn("twice", 0, "q", "a", [], "d1"), turn("twice", 0, "q", "b", [], "d2"),
        turn("stray", 0, "q", "a", []), turn("stray", 1, "q1", "a1", ["q", "other"]), turn("late", 1, "q", "a", []),
        ("j", "json", 0, "{\"question\": \"q", "completed", "{}", T0), (None, "null", None, None, None, None, None), ("x", None, 0, "{}", "completed", "{}", T0),
    ]
    d = spark.createDataFrame(rows, ATTEMPT).withColumn("reason", F.lit(1)).withColumn("tree", F.lit(2))
    verdict, _ = conversations.judge(conversations.turns(d))
    got = {r["case_id"]: r["reason"] for r in verdict.collect()}
    assert got == {"good": None, "silent": "missing_reply", "blank": "empty", "gap": "broken", "twice": "broken", "stray": "broken", "late": "broken", "json": "broken", "null": "broken"}
    said = conversations.conversations(d)
    assert [(r["role"], r["content"]) for r in said.orderBy("position").collect()] == [("user", "q0"), ("assistant", "a0"), ("user", "q1"), ("assistant", "a1")]
    assert [len(r["messages"]) for r in conversations.conversation_lists(said, 3).orderBy("part").collect()] == [3, 1]
    assert conversations.conversations(spark.createDataFrame([], ATTEMPT)).count() == 0


# ---------------------------------------------------------------- 8 packing
@pytest.mark.parametrize("text", ["", "a", "It's 12,5 % — của  và\n\n\tx_y ", "word" * 3000 + " end", " " * 300 + "x", "<|endoftext|> ok", "ﬁ ½ é e\u0301 😀\u200d", "a b " * 2000])
def test_words_sum_up_to_their_text(text):
    path = f"{tokens.TOKENIZERS}/{tokens.DEFAULT}"
    assert tokens.word_sizes(path) is not None
    n = len(tokens.tokenizer(path).encode(text, add_special_tokens=False).ids)
    assert tokens.count_tokens([text, text], path) == [n, n]
    if text:
        cut = tokens.cuts(text, 20, path)
        assert "".join(text[b:e] for b, e, _ in cut) == text and sum(k for _, _, k in cut) == n and max(k for _, _, k in cut) <= 20


def test_at_most_one_bin_is_half_empty(spark):
    """Items a little over a third of the capacity, many more than one task takes."""
    rows = [("k", 100, s, [(i, 0, 0, 0, 0, s, s)]) for i, s in enumerate([34 + i % 3 for i in range(900)])]
    got = packing.pack(spark.createDataFrame(rows, packing._BIN), per_task=40).collect()
    assert sorted(m["doc_id"] for b in got for m in b["members"]) == list(range(900)) and all(b["size"] <= 100 for b in got)
    assert sum(b["size"] * 2 <= 100 for b in got) <= 1


def test_best_fit_never_overfills():
    r = random.Random(6)
    sizes = [r.randint(1, 100) for _ in range(500)]
    bins = packing.best_fit(sizes, 100)
    assert sorted(i for b in bins for i in b) == list(range(500)) and all(sum(sizes[i] for i in b) <= 100 for b in bins)
    assert len(bins) <= -(-sum(sizes) // 100) * 1.1 + 1


def docs(spark, texts):
    return spark.createDataFrame([(i, t, s) for i, (t, s) in enumerate(texts)], "doc_id long, text string, source string").withColumn("tokens", F.lit(1))


def test_packing_round_trip(spark):
    r = random.Random(8)
    texts = [(" ".join(r.choice(["alpha", "beta", "gamma"]) for _ in range(r.randint(1, 60))), "s") for _ in range(300)] + [("word " * 900, "s"), (None, "s"), ("", "s")]
    d = docs(spark, texts)
    d = d.unionByName(d.where("doc_id = 5"))
    sizes = spark.createDataFrame([("short", 128), ("wide", 512)], "pack_kind string, capacity_tokens int")
    got = packing.packed_documents(d, sizes, per_task=60).cache()
    cap = {"short": 128, "wide": 512}
    for row in got.groupBy("pack_kind", "bin").agg(F.sum("tokens").alias("t")).collect():
        assert row["t"] <= cap[row["pack_kind"]]
    for kind in cap:
        k = got.where(F.col("pack_kind") == kind)
        assert k.where("doc_id = 5").count() == 2 and k.select("doc_id").distinct().count() == 301
        parts = k.where("doc_id = 300").orderBy("part").collect()
        assert "".join(texts[300][0][p["begin"] : p["end"]] for p in parts) == texts[300][0] and (len(parts) > 1)
        used = k.agg(F.sum("tokens")).first()[0] / (k.select("bin").distinct().count() * cap[kind])
        assert used > 0.93
    assert packing.packed_documents(d.where("false"), sizes).count() == 0


def test_nearest_reaches_what_few_documents_allow():
    sizes, most, want = [52, 204, 216, 786, 6115], [3] * 5, 2960
    best = min(abs(want - sum(a * b for a, b in zip(sizes, c))) for c in itertools.product(range(4), repeat=5))
    change = mixing.nearest(sizes, [1, 1, 1, 1, 0], most, want - sum(sizes[:4]))
    got = sum(t * (k + m) for t, k, m in zip(sizes, [1, 1, 1, 1, 0], change))
    assert all(0 <= k + m <= 3 for k, m in zip([1, 1, 1, 1, 0], change)) and abs(want - got) <= max(best, 0.01 * want)
    assert mixing.nearest([], [], [], 5.0) == [] and mixing.nearest([7], [1], [1], 3.0) == [0]


# ---------------------------------------------------------------- 9 mixing
def test_mix_meets_its_targets(spark):
    r = random.Random(3)
    texts = [("word " * r.randint(5, 80), s) for s, n in (("big", 400), ("mid", 120), ("few", 30)) for _ in range(n)] + [(None, "big"), ("stray text", None), ("other", "none")]
    targets = spark.createDataFrame([("big", 0.5, 1), ("mid", 0.3, 2), ("few", 0.15, 4), ("absent", 0.05, 2)], "source string, target_share double, max_repeats int")
    mix = mixing.mixed(mixing.measured(docs(spark, texts)), targets).cache()
    most = {"big": 1, "mid": 2, "few": 4}
    assert all(1 <= row["copies"] <= most[row["source"]] for row in mix.collect())
    shares = {x["source"]: x["actual_share"] for x in mixing.report(mix, targets, mixing.measured(docs(spark, texts))).collect()}
    for s, want in (("big", 0.5), ("mid", 0.3), ("few", 0.15)):
        assert shares[s] == pytest.approx(want / 0.95, abs=0.02)
    assert shares["absent"] == 0
    assert mixing.mixed(mixing.measured(docs(spark, texts)).where("false"), targets).count() == 0


def test_token_cuts():
    path = f"{tokens.TOKENIZERS}/{tokens.DEFAULT}"
    text = "Điểm giữa kỳ chiếm 40 phần trăm. " * 80 + "x" * 3000
    cut = tokens.cuts(text, 100, path)
    assert "".join(text[b:e] for b, e, _ in cut) == text and all(n <= 100 for _, _, n in cut) and sum(n for _, _, n in cut) == tokens.count_tokens([text], path)[0]


# ---------------------------------------------------------------- 10 subjects
def test_subjects_on_held_out_documents(spark):
    r = random.Random(11)
    words = {"law": ["court ruling", "contract clause", "tort claim", "appeal"], "sport": ["tennis court", "relay race", "marathon pace", "goalkeeper"], "administration": ["tuition fee", "library card", "leave of absence", "re-sit"]}
    frames = ["Week {n} deals with the {w} and the {v}.", "A report explains why the {w} matters for the {v}.", "Students practise the {w} before the {v}."]

    def doc(kinds):
        return " ".join(r.choice(frames).format(n=r.randint(1, 20), w=r.choice(words[k]), v=r.choice(words[k])) for k in kinds)

    rows = []
    for _ in range(400):
        kinds = r.sample(["law", "sport"], r.choice([1, 1, 2])) if r.random() < 0.8 else ["administration"]
        rows.append((doc([k for k in kinds for _ in range(r.randint(3, 5))]), "s", None, kinds))
    model = subjects.train(rows[:300], sorted(words))
    sets, p = decoded(model, rows[300:])
    right = [got == set(kinds) for got, (_, _, _, kinds) in zip(sets, rows[300:])]
    assert sum(right) >= 90
    # the calibrated probability of a combination is about the share of right ones
    assert abs(model.calibrated(p).mean() - sum(right) / len(right)) < 0.08
    d = spark.createDataFrame([(1, doc(["law"] * 5), "s", None), (1, doc(["law"] * 5), "s", None), (2, None, None, None), (3, "", "s", "x"), (4, "no known words", "s", None)], "doc_id long, text string, source string, doc_kind string")
    assert [(x["doc_id"], x["subject"]) for x in subjects.subjects_of(d, model).collect()] == [(1, "law")]


def decoded(model, rows):
    flags, p = model.decode(*subjects.describe([x[0] for x in rows], [x[1] for x in rows], [x[2] for x in rows], model.term_model, len(model.subjects)))
    return [{model.subjects[i] for i, on in enumerate(f) if on} for f in flags], p


def held_out(rows, names):
    model = subjects.train([r for i, r in enumerate(rows) if i % 4], names)
    return sum(got == set(kinds) for got, (_, _, _, kinds) in zip(decoded(model, rows[::4])[0], rows[::4])) / len(rows[::4])


def test_background_is_read_off_the_labels():
    r = random.Random(3)
    labels = [[0] if r.random() < 0.3 else sorted(r.sample([1, 2, 3], r.choice([1, 2]))) for _ in range(200)]
    assert subjects.background_subject(labels, 4) == 0
    assert subjects.background_subject([[0], [1], [0, 1]], 2) is None and subjects.background_subject([], 2) is None


def test_runs_of_words_are_scored_as_their_terms():
    text = ["The red fox jumps.", "A red fox, a red fox!", "Nothing here", ""]
    m = subjects.fit_terms([["The red fox jumps high.", "The red fox sleeps."], ["A blue whale sings.", "The blue whale sleeps."]], [[0], [1]], ["s", "s"], 2, None)
    which, z = m.scores(text)
    for k, row in zip(which, z):
        at = [m.vocabulary[t] for t in subjects.terms(text[k]) if t in m.vocabulary]
        assert abs(row - m.weight[at].sum(0) / m.info[at].sum()).max() < 1e-5
    assert set(which) == {k for k, t in enumerate(text) if sum(m.info[m.vocabulary[x]] for x in subjects.terms(t) if x in m.vocabulary) > 1e-9}


def test_each_subject_learns_its_own_partners_and_sources():
    r = random.Random(5)
    words = {"law": ["court ruling", "contract clause", "tort claim"], "med": ["blood sample", "heart surgery", "fever chart"], "both": ["open letter", "public debate", "long essay"]}
    say = lambda k: " ".join(f"The {r.choice(words[k])} follows the {r.choice(words[k])} in week {r.randint(1, 9)}." for _ in range(3))
    partner = {"law": "alpha", "med": "beta"}  # their sentences have the same words
    rows = [(f"{say(k)} {say('both')}", "s", None, [k, partner[k]]) for k in (r.choice(["law", "med"]) for _ in range(240))]
    rows += [(say(k), "s", None, [k]) for k in (r.choice(["law", "med"]) for _ in range(120))]
    r.shuffle(rows)
    assert held_out(rows, ["alpha", "beta", "law", "med"]) >= 0.9
    rows = [(say("both"), s, None, [k]) for s, k in (r.choice([("one", "alpha"), ("two", "beta"), ("three", "alpha"), ("four", "beta")]) for _ in range(240))]
    assert held_out(rows, ["alpha", "beta"]) >= 0.9


@pytest.mark.parametrize("n", [300, 500])
def test_rare_labels_train_at_every_size(n):
    rows = [(f"The court ruling follows the appeal in week {i}. The judge hears the claim again.", "s", None, ["law"]) for i in range(n)]
    for i in (2, 4):  # the other half has no such document
        rows[i] = (f"{rows[i][0]} The zymurgy seminar ferments barley daily.", "s", None, ["law", "brewing"])
    model = subjects.train(rows, ["brewing", "law"])
    assert "zymurgy" in model.term_model.vocabulary
    _, z = model.term_model.scores(["The zymurgy seminar ferments barley daily."])
    assert z.argmax(1).tolist() == [0]


def test_training_on_nothing(spark):
    model = subjects.train([], ["a", "b"])
    d = spark.createDataFrame([(1, "some text here.", "s", None)], "doc_id long, text string, source string, doc_kind string")
    assert subjects.subjects_of(d, model).count() == 0


def test_languages():
    assert language("The course is assessed by a test and a paper.") == "en" and language("Le cours est évalué par un contrôle et une épreuve.") == "fr" and language("Học phần được đánh giá bằng bài thi viết.") == "vi" and language("Hoc phan nay co bao nhieu tin chi?") == "vi" and language("12345") is None
