"""License texts whose sentences wrap, and long lines with a template's words far apart."""

from wardflow.llm import license_scan

MIT = """Copyright (c) 2020 A. Person

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files, to deal in it"""
BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:"""
GPL = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU GPL as published"""


def test_wrapped_sentences_meet_their_template(spark):
    def commented(mark, text):
        return "\n".join(f"{mark} {line}" for line in text.split("\n"))

    filler = " ".join(f"x{i}" for i in range(37))
    texts = [MIT, BSD, GPL, commented(" *", MIT), commented("dnl", BSD), commented("#", GPL),
             f"{filler} {BSD} {filler}", "\n".join(BSD.split()), "all\nrights\nreserved", MIT.replace("\n", " ")]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in license_scan.scan_licenses(docs).collect()}
    assert [got[i].labels for i in range(len(texts))] == [
        ["mit"], ["bsd"], ["gpl"], ["mit"], ["bsd"], ["gpl"], ["bsd"], ["bsd"], ["proprietary"], ["mit"]]
    assert all(r.score >= license_scan.CONTAINMENT for r in got.values())


def test_words_scattered_over_a_long_line_meet_nothing(spark):
    words = sorted({w for t in license_scan.TEMPLATES for w in t.text.split()})
    scattered = " ".join(f"{w} " + " ".join(f"y{i}" for i in range(40)) for w in words)
    docs = spark.createDataFrame([(0, scattered), (1, f"{scattered} {' '.join(BSD.split())} {scattered}")],
                                 "doc_id long, text string")
    got = {r.doc_id: (r.labels, r.score > 0) for r in license_scan.scan_licenses(docs).collect()}
    assert got == {0: ([], False), 1: (["bsd"], True)}
