"""Sentence units: scripts, masks, blocks, odd texts; no text lost."""

import pytest
from pyspark.sql import functions as F

from tabulon.llm import sentences as S


def cut(spark, text):
    df = spark.createDataFrame([(1, text, "x")], "doc_id long, text string, b string")
    return [r["sentence"] for r in S.sentences(df).orderBy("start_pos").collect()]


@pytest.mark.parametrize(
    "text, want",
    [
        ("Heading\n\n[1] Mr. Stone paid Cr. 3.50 on 5 Sept. 1996. It follows, e.g. from reg. 506, that A.B. and X Ltd. were late. Why?", ["Heading", "[1] Mr. Stone paid Cr. 3.50 on 5 Sept. 1996.", "It follows, e.g. from reg. 506, that A.B. and X Ltd. were late.", "Why?"]),
        ("12. The boat went to Stone Ltd. The pier\nstayed. He wrote “No! Never.” in it. She said: “Stop. Now!” Then all left. See www.a.org now.", ["12. The boat went to Stone Ltd.", "The pier\nstayed.", "He wrote “No! Never.” in it.", "She said: “Stop. Now!”", "Then all left.", "See www.a.org now."]),
        ("Am 9. Tag kam Dr. Berg, vgl. OG, Urt. v. 2. März 2009, i. S. d. § 5 Abs. 1 ZO. Es gehört Tal u. a. Der Zeuge sagte: „Nein. Nie!“ Ende.", ["Am 9. Tag kam Dr. Berg, vgl. OG, Urt. v. 2. März 2009, i. S. d. § 5 Abs. 1 ZO.", "Es gehört Tal u. a.", "Der Zeuge sagte: „Nein. Nie!“", "Ende."]),
        ("Selon l'art. R. 501, M. Roc a noté « Où ? » avant. Il dit : « Non ! » La cour, 7 déc. 2006, n° 1/2, a jugé.", ["Selon l'art. R. 501, M. Roc a noté « Où ? » avant.", "Il dit : « Non ! »", "La cour, 7 déc. 2006, n° 1/2, a jugé."]),
        ("¿Era nulo? ¡Sí! El Sr. Mar pagó 1.000,5 según el núm. 7. Nadie.", ["¿Era nulo?", "¡Sí!", "El Sr. Mar pagó 1.000,5 según el núm. 7.", "Nadie."]),
        ("他写下“好。没有。”并走了。价值3.5元。证人称：“在哪里？”他走了。", ["他写下“好。没有。”并走了。", "价值3.5元。", "证人称：“在哪里？”", "他走了。"]),
        ("彼は「良い。」と述べた。次か？終わり。", ["彼は「良い。」と述べた。", "次か？", "終わり。"]),
        ("न्या. Roy ने “कहाँ है?” लिखा। गवाह ने कहा: “यहाँ।” रु. 5.5 में बिका।", ["न्या. Roy ने “कहाँ है?” लिखा।", "गवाह ने कहा: “यहाँ।”", "रु. 5.5 में बिका।"]),
        ("गवाह ने कहा: “यह मौखिक है। किसी ने नहीं देखा।” Roy का कहना है। वह ने “कहाँ है?” लिखा।", ["गवाह ने कहा: “यह मौखिक है। किसी ने नहीं देखा।”", "Roy का कहना है।", "वह ने “कहाँ है?” लिखा।"]),
        ("证人称：“在哪里？”2021年他走了。证人称：“好。”[redacted]先付。", ["证人称：“在哪里？”", "2021年他走了。", "证人称：“好。”", "[redacted]先付。"]),
        ("It is late, cf. Sec. 2 of the code. a boat near stone cost approx. ten crowns. on 3 sept. 2011 stone ltd. and roe corp. left on 9.4.1992. no one came.", ["It is late, cf. Sec. 2 of the code.", "a boat near stone cost approx. ten crowns.", "on 3 sept. 2011 stone ltd. and roe corp. left on 9.4.1992.", "no one came."]),
        ("(1) ศาลเห็น 3.6.1998 ว่า ดี. ไม่ Ltd. แล้ว จำเลย\nอ้าง", ["(1) ศาลเห็น 3.6.1998 ว่า", "ดี. ไม่ Ltd. แล้ว", "จำเลย", "อ้าง"]),
        ("It went to X…. They asked … but left. [redacted] said no.", ["It went to X….", "They asked … but left.", "[redacted] said no."]),
        ("A 😀 day. Next one.", ["A 😀 day.", "Next one."]),
    ],
)
def test_units(spark, text, want):
    assert cut(spark, text) == want


def test_odd_texts_and_nothing_lost(spark):
    long = "Word " * 30_000 + "end. " + "x" * 100_000 + "\n\n" + "“" * 500 + " A. b. C"
    texts = [None, "", "  \n\n \t", "\n\nA.\n\n\n \nB", "“open. Never closed. Done.", "....", "A.\r\n\r\nB. C.", long, "A.\r\n\r\nB. C."]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("start_pos", F.lit("clash"))
    got = {}
    for r in S.units(df).collect():
        got.setdefault(r["doc_id"], []).append((r["start_pos"], r["end_pos"]))
    assert not {0, 1, 2} & set(got)
    for i, t in enumerate(texts[3:], 3):
        at = 0
        for a, b in sorted(got[i]):
            assert a >= at and not t[at:a].strip() and t[a:b] == t[a:b].strip() and b > a
            at = b
        assert not t[at:].strip()
    assert sorted(got[6]) == sorted(got[8]) and S.units(df.limit(0)).count() == 0


def test_corpus_is_covered(spark, sf):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    ends = {}
    for r in S.units(spark.read.parquet(f"{sf}/documents.parquet")).orderBy("doc_id", "start_pos").collect():
        assert not docs[r["doc_id"]][ends.get(r["doc_id"], 0) : r["start_pos"]].strip()
        ends[r["doc_id"]] = r["end_pos"]
    assert all(not t[ends.get(i, 0) :].strip() for i, t in docs.items())
