"""Lines that differ in case alone are copies, whichever words it is in."""

from __future__ import annotations

from lexaudit.llm import op3_lines

SCHEMA = "doc_id long, text string"


def test_case_variants_go(spark):
    rows = [
        (1, "Subscribe To Our Weekly Newsletter Today\nTerms Of Use"), (2, "SUBSCRIBE TO OUR WEEKLY NEWSLETTER TODAY\nkept as it is Here"), (3, "subscribe to our weekly newsletter today\nTERMS of use"),
        (4, "Subscribe to OUR weekly newsletter TONIGHT\nÉtat Général Des Lieux"), (5, "ÉTAT GÉNÉRAL DES LIEUX\nAnother line of its own"),
    ]
    got = {r.doc_id: r.text for r in op3_lines.dedup_lines(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {1: rows[0][1], 2: "kept as it is Here", 3: "", 4: "État Général Des Lieux", 5: "Another line of its own"}
