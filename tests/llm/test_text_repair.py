from __future__ import annotations

from conftest import rows

from curralign.llm import evidence, scans, sentences
from curralign.llm.evidence import Counts

WORDS = {w: 100 for w in "given students learn about fractions and number line the order of one two digit infer pattern well organized into words with pass each for in volume".split()}
WORDS |= {"learners": 90, "well-organized": 20, "infer": 100, "passwords": 50}
DEC = scans.Decoder(scans.counts_of(WORDS, {"valmere core framework": 30}))


def test_noise_kinds():
    assert DEC.noise("learn-\ners and students") == {"hyphen"}
    assert DEC.noise("learn¬\ners") == {"hyphen"} == DEC.noise("learn- ers") == DEC.noise("learn-  \ners")
    assert DEC.noise("one- and two-digit number") == set()
    assert DEC.noise("well-\norganized number line") == set()
    assert DEC.noise("the pattem of iiifer") >= {"character"}
    assert DEC.noise("w0rds in 0rder") == {"character"}
    assert DEC.noise("the order\n[12]\nof one") == {"page number"} == DEC.noise("xiv\nthe order") == DEC.noise("the\n– 76 –\norder") == DEC.noise("the\n7 | Page\norder")
    assert DEC.noise("the order\n12  Valmere Core Framework\nof one") == {"header"}
    assert DEC.noise("12") == DEC.noise("the order of 12 words\nin one line") == set()
    assert DEC.noise("• one\n• two\n1) three") == set()


def test_repair():
    text = "Given the pattem of learn-\r\ners\nVALMERE CORE FRAMEWORK | 7\nand pass-\nwords with one- and two-digit\nnumber\n3\nin the w0rds."
    read, kinds = DEC.repair(text)
    assert read == "Given the pattern of learners and passwords with one- and two-digit number in the words."
    assert kinds == {"hyphen", "header", "page number", "character"}
    assert DEC.repair("One.\n\nTwo\nthree")[0] == "One.\nTwo three"
    assert DEC.repair("List:\n• a\n• b")[0] == "List:\n• a\n• b"


def test_joint_segmentation_splits_and_merges():
    assert DEC.decode(["numberline"], [])[0] == "number line"
    assert DEC.decode(["stu", "dents"], [" "])[0] == "students"
    assert DEC.decode(["orcler"], []) == ("order", {"character"})


def test_frames(spark):
    base = [("t", f"g{i}", "students learn about fractions and the number line in order") for i in range(30)]
    df = spark.createDataFrame(base + [("t", "bad", "frac-\ntions and numbcr"), ("t", "bad", "frac-\ntions and numbcr"), ("t", "n", None), ("t", "e", ""), ("t", "b", "  ")], "tbl string, id string, text string")
    assert rows(scans.find_noise(df), "tbl", "id") == [("t", "bad")]
    fixed = {r[0]: r[1] for r in rows(scans.repair_texts(df), "id", "text")}
    assert fixed["bad"] == "fractions and number" and fixed["n"] is None and fixed["e"] == ""
    assert scans.find_noise(df.limit(0)).count() == 0


#: What a corpus would tell: stops that go on, with digits, before capitals and at ends of paragraphs; common words and names.
SEEN = {"total": 9000, "total e": 1500, "tthe": 500, "mThe": 20, "mHadrel": 90, "mOrvane": 90, "ou" + "der": 40, "ol" + "der": 5}
SEEN |= {f"su{w}": 300 for w in "dr mr κ د डॉ".split()} | {f"sd{w}": 90 for w in "approx fig p ch no ص पृ".split()}
SEEN |= {"slcf": 60, "sucf": 60, "slεκ": 60, "slp.m": 3, "sup.m": 90, "sep.m": 20, "vbasked": 40, "vasaid": 50, "tsaid": 60}
SP = sentences.Splitter(Counts(SEEN))


def cut(text):
    return [text[a:b] for a, b in SP.split(text)]


def test_abbreviations_numbers_and_names():
    text = "Dr. Hadrel left at 3 p.m. on Monday. The mass was approx. 98.6 kg; it fell. See Fig. 3 and Table 2.7 (cf. Ch. 3, p. 12) first.The end. pH 7.0 is neutral."
    assert cut(text) == ["Dr. Hadrel left at 3 p.m. on Monday.", "The mass was approx. 98.6 kg; it fell.", "See Fig. 3 and Table 2.7 (cf. Ch. 3, p. 12) first.", "The end.", "pH 7.0 is neutral."]
    assert cut("It ended at 5 p.m. The club left.") == ["It ended at 5 p.m.", "The club left."]
    assert cut("In der 2. Stunde war Dr. Orvane da. Siehe S. 2 im Heft.") == ["In der 2. Stunde war Dr. Orvane da.", "Siehe S. 2 im Heft."]
    assert cut("At https://a.example/x.7/t?id=3. The V.R. Board met.") == ["At https://a.example/x.7/t?id=3.", "The V.R. Board met."]


def test_abbreviations_of_the_document():
    on = "The distr. of Orvane was large. "
    assert cut(on + "The distr. Orvane met. See it.") == ["The distr. of Orvane was large.", "The distr. Orvane met.", "See it."]
    assert cut(on + "It is a distr. The end.") == ["The distr. of Orvane was large.", "It is a distr.", "The end."]
    assert cut("A plan. then it ends. The plan is made with Orvane. It is a plan. Orvane left.")[-1] == "Orvane left."
    assert cut("The distr. Orvane met.") == ["The distr.", "Orvane met."]


def test_document_decides_without_a_corpus():
    alone = sentences.Splitter(Counts({}))
    text = "The qzt. of it was seen. He saw qzt. marks here. Then qzt. Bravo came."
    assert [text[a:b] for a, b in alone.split(text)] == ["The qzt. of it was seen.", "He saw qzt. marks here.", "Then qzt. Bravo came."]
    assert alone.corpus_class("qzt") == ""


def test_corpus_classes_are_learned():
    text = "The class met Xr. Hadrel in the hall. It was zca. 12 long, and the hall was full.\n\nThe hall was full. It was full. The end of the hall was near.\n\nThey saw the hall, and the hall was near."
    counts: dict = {}
    for _ in range(60):
        for k in sentences.evidence_keys(text):
            counts[k] = counts.get(k, 0) + 1
    sp = sentences.Splitter(Counts(counts))
    assert [sp.corpus_class(w) for w in ("xr", "zca", "full", "unseen")] == ["never", "short digit", "plain", ""]
    more = "Xr. Orvane left. It is zca. 7. Hall."
    assert [more[a:b] for a, b in sp.split(more)] == ["Xr. Orvane left.", "It is zca. 7.", "Hall."]


def test_rare_evidence_is_looked_up(spark):
    texts = ["The class met Xr. Hadrel in the hall. It was zca. 12 long.\n\nThe hall was full. It was full."] * 60 + ["Xr. Orvane asked. The zca. Hall met. The end.", None, ""]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    whole, few = (sentences.evidence.learn(df, "text", sentences.evidence_keys, 2, keep) for keep in (None, 7))
    assert whole.complete and not few.complete
    assert rows(sentences.split_sentences(df, known=few)) == rows(sentences.split_sentences(df, known=whole))
    assert evidence.learn(df.limit(0), "text", sentences.evidence_keys).complete


def test_quotations_brackets_and_ellipses():
    assert cut('The class wrote: "It was hard. We won!" The end.') == ['The class wrote: "It was hard. We won!"', "The end."]
    assert cut('"Stop. Count again," said Mr. Quist. “Who?” one pupil asked. (See No. 2.) Did he say "no"?! Yes.') == ['"Stop. Count again," said Mr. Quist.', "“Who?” one pupil asked.", "(See No. 2.)", 'Did he say "no"?!', "Yes."]
    assert cut("It was long … and then it ended. Aber … jedes Paar kam.") == ["It was long … and then it ended.", "Aber … jedes Paar kam."]
    assert cut("„Wie viele?“, fragte sie. Er rief: „Noch einmal. Los!“ Ende.") == ["„Wie viele?“, fragte sie.", "Er rief: „Noch einmal. Los!“", "Ende."]


def test_scripts():
    assert cut("他问：“还剩多少？”再数一次。“好。”老师说。（没有。）") == ["他问：“还剩多少？”", "再数一次。", "“好。”老师说。", "（没有。）"]
    assert cut("「もう一度。早く！」と言った。図3.25を見よう。") == ["「もう一度。早く！」と言った。", "図3.25を見よう。"]
    assert cut("डॉ. हद्रेल आए। पृ. 3 देखिए।") == ["डॉ. हद्रेल आए।", "पृ. 3 देखिए।"]
    assert cut("وصف د. تلبرين الجدول. لماذا؟ انظر ص. 7 هنا.") == ["وصف د. تلبرين الجدول.", "لماذا؟", "انظر ص. 7 هنا."]
    assert cut("Γιατί ήρθε; Ο κ. Τελβρίν έμεινε· η τάξη όχι. Ήταν 3,5 εκ. και όχι 4.") == ["Γιατί ήρθε;", "Ο κ. Τελβρίν έμεινε· η τάξη όχι.", "Ήταν 3,5 εκ. και όχι 4."]
    assert cut("ครูวาดรูป นักเรียนดู ค่าคือ 3 เมตร แล้วจบ") == ["ครูวาดรูป", "นักเรียนดู", "ค่าคือ 3 เมตร", "แล้วจบ"]


def test_blocks_and_lists():
    text = "A Heading\r\n\r\nA sentence that\nwraps. Another.\n\nSteps:\n1. Bring it. Now!\n2. the map\n\n(cf. p.\n12) was it."
    assert cut(text) == ["A Heading", "A sentence that\nwraps.", "Another.", "Steps:", "1. Bring it. Now!", "2. the map", "(cf. p.\n12) was it."]
    assert cut("") == cut(" \n\xa0　") == []


def test_sentence_frame(spark):
    df = spark.createDataFrame([(1, "One. Two.", "x"), (2, None, "x"), (3, "", "x"), (4, " \n ", "x")], "doc_id long, text string, start_char string")
    assert rows(sentences.split_sentences(df)) == [(1, 0, 4), (1, 5, 9)]
    assert sentences.split_sentences(df.limit(0)).count() == 0


def test_very_long_text():
    text = "A sentence of words. " * 20_000
    assert len(SP.split(text)) == 20_000


def test_cut_words_without_hyphen_and_words_run_together():
    assert DEC.noise("the learn\ners infer") == {"merge"} == DEC.noise("the learn ers infer")
    assert DEC.repair("Given the learn\ners and the num ber line")[0] == "Given the learners and the number line"
    assert DEC.noise("the numberline of each") == {"split"}
    assert DEC.repair("the numberline of each")[0] == "the number line of each"
    assert DEC.repair("the learn\nersand students")[0] == "the learners and students"
    assert DEC.noise("the number\nline and learners") == set() == DEC.noise("in the pass each line")
    assert DEC.noise("for the Numberline in one") == set() == DEC.noise("the order of numberline…")


def test_halves_at_hyphens_are_no_words():
    d = scans.Decoder(scans.counts_of(WORDS | {"ers": 60, "learn": 160}, {}, {"ers": 60, "learn": 60}))
    assert d.noise("the learn ers infer") == {"merge"}


def test_run_together_words_are_repaired_but_no_case(spark):
    base = [("t", f"g{i}", "students learn about fractions and the number line in order") for i in range(30)]
    df = spark.createDataFrame(base + [("t", "cut", "the frac\ntions in order"), ("t", "run", "the numberline in order")], "tbl string, id string, text string")
    assert rows(scans.find_noise(df), "id") == [("cut",)]
    fixed = {r[0]: r[1] for r in rows(scans.repair_texts(df), "id", "text")}
    assert fixed["cut"] == "the fractions in order" and fixed["run"] == "the number line in order"


def test_probe_of_merges_splits_and_chains():
    d = scans.Decoder(scans.counts_of(WORDS | {"curriculum": 80}))
    assert d.repair("the curri culum and thenumberline and frac-\nti-\nons") == ("the curriculum and the number line and fractions", {"merge", "split", "hyphen"})
    long = "x" * 70
    assert d.repair(f"the {long}¬\n{long} of one")[0] == f"the {long}{long} of one"
    assert d.repair("\n".join(["the order of one"] * 300))[0] == " ".join(["the order of one"] * 300)


def _marks(spark, n, keep=None):
    """Rows found in a corpus with ``n`` times the clean records and as many other headers."""
    clean = [("t", f"g{i}", "students learn about fractions and the\nnumber line in order", f"f{i % 7}") for i in range(30 * n)]
    heads = [("t", f"h{i}", f"students learn\nHalden Course Plan {i}\nabout the number line", "f1") for i in range(3)]
    bare = [("t", f"b{i}", "students learn\nQuell Course Plan\nabout the number line", "f9") for i in range(6)]
    noise = [("t", "cut", "the frac-\nti-\nons and order", "f1"), ("t", "read", "the numbcr and order", "f1")]
    df = spark.createDataFrame(clean + heads + bare + noise, "tbl string, id string, text string, family string").repartition(3)
    known = None if keep is None else scans.learn(df, "text", "family", keep)
    assert keep is None or not known.complete
    return rows(scans.find_noise(df, known)), rows(scans.repair_texts(df, known).where("not id like 'g%'"))


def test_size_of_the_corpus_and_of_what_travels_change_nothing(spark):
    small = _marks(spark, 1)
    assert {r[1] for r in small[0]} == {"h0", "h1", "h2", "cut", "read", *(f"b{i}" for i in range(6))}
    assert _marks(spark, 12) == small == _marks(spark, 1, 4)


def test_derived_counts_match_those_in_memory(spark):
    texts = [("the number line",)] * 40 + [("the numberline",)] * 5 + [("num ber",)] * 3 + [("number-line",)] * 3
    ev = scans.learn(spark.createDataFrame(texts, "text string"))
    words = {k[1:]: n for k, n in ev.known.value.items() if k.startswith("w")}
    parts = {k[1:]: n for k, n in ev.known.value.items() if k.startswith("p")}
    want = scans.counts_of(words, {}, parts).known
    assert {k: n for k, n in ev.known.value.items() if k[0] == "f" or k in ("most", "longest")} == {k: n for k, n in want.items() if k[0] == "f" or k in ("most", "longest")}
