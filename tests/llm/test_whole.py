"""Cases in which an operator once did less than the whole job."""

from __future__ import annotations

import random
import textwrap
from collections import Counter

from lintlake.llm import decontaminate, fingerprints, license_scan, line_dedup, near_dedup, pii, toxicity


# ---- line dedup


def test_line_dedup_decides_by_line(spark):
    """A long footer goes from short pages too; copies of one text keep their lines; one occurrence stays."""
    footer, copied = "A long footer that every one of these short pages carries.", "A whole text\nthat was copied as it is."
    rows = [(k, f"page {k}\n{footer}", f"site{k}") for k in range(12)] + [(100 + k, copied, f"site{k}") for k in range(12)]
    rows += [(200 + k, f"{footer}\n{'longer text of a page ' * 9}{k}", f"site{k}") for k in range(3)] + [(5, rows[5][1], "site5")]
    rows += [(None, f"null\n{footer}\n{footer}", None)]
    got = line_dedup.clean_documents(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    want = Counter((i, t if i == 0 or t == copied else "\n".join(x for x in t.split("\n") if x != footer)) for i, t, _ in rows)
    assert Counter((r.doc_id, r.text) for r in got.collect()) == want


# ---- fingerprints


def test_fingerprints_keep_all_anchors(spark):
    """A short passage shared by long texts is seen, all anchors are there, and texts without spaces have letters."""
    rng = random.Random(1)
    words = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    passage = words(60)
    rows = [(1, f"{words(6000)} {passage} {words(50)}"), (2, f"{words(400)} {passage} {words(5600)}"), (3, "".join(chr(0x4E00 + rng.randrange(3000)) for _ in range(2000))), (4, "")]
    got = {r.doc_id: r for r in fingerprints.edited_likeness(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i in (1, 2, 3):
        anchors = [(x.pos, x.hash) for x in got[i].anchors]
        size = len(rows[i - 1][1].split()) if i < 3 else 2000
        assert 0.5 * size < len(anchors) < 0.85 * size and anchors == sorted(anchors) and anchors[-1][0] <= size
        smallest = sorted({h for _, h in anchors})[:128]
        assert got[i].fingerprint == "".join(f"{h:08x}" for h in smallest)
    a, b = ({x.hash for x in got[i].anchors} for i in (1, 2))
    assert len(a & b) >= 25 and got[1].near_next == len(a & b) / len(a | b)
    e = {(x.pos, x.hash) for x in got[1].edited_anchors}
    assert got[1].n_placed_edited == len(e & {(x.pos, x.hash) for x in got[1].anchors}) > 0.7 * len(got[1].anchors)
    assert got[3].near_edited > 0.5 and got[4].anchors == []


# ---- personal data


def test_personal_data_of_several_words(spark):
    """Spaced phones, cards that fail the check digit and spelt-out addresses are found, as whole runs."""
    lead = "ab cd ef gh ij kl mn op qr st".split()
    rows = [f"lorem {w} please call my desk at +1 (724) 555-70{k} today or later" for k, w in enumerate(lead, 10)]
    rows += [f"ipsum {w} charge my card number 4111 1111 1111 {c} before noon then" for w, c in zip(lead, "1111 1129 1137 1145 1152 1160 1178 1186 1194 1202".split(), strict=True)]
    rows += [f"dolor {w} write a letter to {w}@example.com or to me" for w in lead]
    new = {
        "so please call my desk at (724) 555-7058 today or later": "phone:(724) 555-7058",
        "so please call my desk at 724 555 7099 today or later": "phone:724 555 7099",
        "so please call my desk at (724 555 7098) today or later": "phone:724 555 7098",
        "so charge my card number 4111 1111 1111 1112 before noon then": "card:4111 1111 1111 1112",
        "so write a letter to jane at example dot com or to me": "email:jane at example dot com",
        "in 1999 2001 2003 it was": "", "look at me now or never": "",
    }
    df = spark.createDataFrame(list(enumerate([*rows, *new])), "doc_id long, text string")
    got = {r.doc_id: r.spans for r in pii.find(df).collect()}
    for i, (text, want) in enumerate(new.items(), len(rows)):
        found = [x.split(":") for x in got[i].split(",") if x]
        assert ",".join(f"{k}:{text[int(s) : int(e)]}" for k, s, e in found) == want, text


# ---- licences

MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
persons to whom the Software is furnished to do so, subject to the following conditions:"""
BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
following conditions are met:"""
GPL = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public
License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."""


def test_wrapped_licenses(spark):
    """Notices wrapped at 50 to 80 columns are one statement of their family, with and without comment marks."""
    documents = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rows, want = [], {}
    for family, notice in (("mit", MIT), ("bsd", BSD), ("gpl", GPL)):
        for k, (columns, mark) in enumerate([(50, ""), (70, "# "), (80, " * "), (76, "// ")]):
            body = [mark + x for x in textwrap.wrap(" ".join(notice.split()), columns)]
            before = [[], ["Lore dorem anest."], [mark, mark + "Copyright (c) 2020 Jane"], ["Lore dorem anest.", ""]][k]
            rows.append((10**6 + len(rows), "\n".join([*before, *body, mark, "Thand whof and thed."])))
            want[rows[-1][0]] = family
    rows.append((2 * 10**6, rows[0][1] + "\n\nReleased under the MIT License.\n\n" + rows[0][1]))
    got = {r.doc_id: r for r in license_scan.license_report(documents.unionByName(spark.createDataFrame(rows, documents.schema))).collect()}
    assert {i: got[i].families for i in want} == want
    assert all(got[i].n_statements == 1 for i in want) and got[2 * 10**6].n_statements == 3


# ---- near duplicates


def test_representatives_by_row(spark):
    """Null ids and shared ids are judged text by text, and repeated rows stay once."""
    rng = random.Random(3)
    text = lambda: " ".join(f"w{rng.randrange(10**6)}" for _ in range(60))
    a, b, c, d = text(), text(), text(), text()
    near = lambda t: t + " end"
    rows = [
        (1, a), (None, a), (None, b), (None, near(b)), (None, c), (None, ""), (None, None),
        (7, d), (7, text()), (9, near(d)), (7, near(a)), (8, text()), (8, rng.choice([text()])),
    ]
    rows += [rows[11], rows[4], rows[5]]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = Counter((r.doc_id, r.text) for r in near_dedup.representatives(df).collect())
    alone = Counter({(1, a): 1, (None, c): 1, (None, ""): 1, (None, None): 1, (7, d): 1, rows[8]: 1, rows[11]: 1, rows[12]: 1})
    assert sum((got - alone).values()) == 1 and set(got - alone) < {(None, b), (None, near(b))} and not alone - got
    flags = Counter((r.doc_id, r.component_id, r.kept) for r in near_dedup.near_duplicates(df).collect())
    assert flags[(9, 7, False)] == 1 and flags[(7, 1, False)] == 1 and flags[(None, 1, False)] == 1


# ---- decontamination


def test_decontamination_by_row(spark):
    """A benchmark of several blocks drops the same rows as one of a single block, where ids are null or shared."""
    items = [(k, f"item {k} asks what number {k * 7} has to do with the word w{k} of the list") for k in range(20)]
    rows = [(None, items[0][1]), (None, "a clean text"), (None, None), (3, items[1][1]), (3, "clean too"), (3, "clean too"), (4, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    for block_bytes in (decontaminate.BLOCK_BYTES, 400):
        got = Counter(map(tuple, decontaminate.clean_documents(df, bench, block_bytes).collect()))
        assert got == Counter(r for r in rows if r not in (rows[0], rows[3]))


# ---- toxicity


def test_nothing_is_rejected_without_labels(spark, documents, corpus):
    """Empty labels, labels of other documents and null labels reject no document."""
    for labels in ([], [(10**9, 1)], [(3, None), (None, 1)]):
        got = toxicity.without_toxic(documents, spark.createDataFrame(labels, "doc_id long, toxic int"))
        assert got.dtypes == documents.dtypes and got.count() == len(corpus)
