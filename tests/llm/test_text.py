"""BPE, packing, toxicity and licences."""
import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from veracity.llm import bpe, licences, packing, toxicity

P = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def byte_tokenizer():
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    t.no_truncation()
    t.no_padding()
    return t


def test_bpe_equals_the_library(byte_tokenizer, odd_texts):
    rng = random.Random(9)
    alphabet = " \n\t  '\"stlvmdreabcxyzABC0123!?.,;éßñИ中文字\U0001F600²½ªⅧ\x85​"
    texts = [t or "" for _, t in odd_texts]
    texts += ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 60))) for _ in range(4000)]
    texts += ["   lead", "trail  ", "a  b", "x\n\n y", "a \n b", "<|endoftext|>", "é" * 3000, " " * 2000, "ha" * 4000]
    enc = bpe.encoder(P.path("byte_bpe_50k.json"))
    mine = [ids.tolist() for _, run in bpe.text_slices(texts) for ids in enc.encode(run)]
    ref = byte_tokenizer.encode_batch(texts, add_special_tokens=False)
    assert mine == [r.ids for r in ref]
    assert [enc.bpe.decode(m) for m in mine] == [byte_tokenizer.decode(r.ids, skip_special_tokens=False) for r in ref]


def test_bpe_decodes_any_ids(byte_tokenizer):
    rng = random.Random(2)
    table = bpe.encoder(P.path("byte_bpe_50k.json")).bpe
    for _ in range(300):
        ids = [rng.randrange(50257) for _ in range(rng.randint(0, 12))]
        assert table.decode(ids) == byte_tokenizer.decode(ids, skip_special_tokens=False)


def test_bpe_splits_every_code_point_like_the_library(byte_tokenizer):
    every = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = [" ".join(f"a{c}'ll" for c in every[i:i + 200]) for i in range(0, len(every), 200)]
    enc = bpe.encoder(P.path("byte_bpe_50k.json"))
    mine = [ids.tolist() for _, run in bpe.text_slices(texts) for ids in enc.encode(run)]
    assert mine == [r.ids for r in byte_tokenizer.encode_batch(texts, add_special_tokens=False)]
    some = ["\u0558", "\u058b", "\U00010940", "\U000187f8", "\u180e", "\x1c", "\u200b", "\u2028"]
    texts = [f"x {c}{c} 1{c}  {c}\n{c} 's{c}'s" for c in some]
    mine = [ids.tolist() for _, run in bpe.text_slices(texts) for ids in enc.encode(run)]
    assert mine == [r.ids for r in byte_tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_bpe_speculation_needs_the_check():
    """Greedy proposals do fail, and the check finds exactly the failing words."""
    table = bpe.encoder(P.path("byte_bpe_50k.json")).bpe
    rng = random.Random(4)
    words = ["".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 14))).encode() for _ in range(3000)]
    greedy, exact = [table.longest_match(w) for w in words], [table.merge_exactly(w) for w in words]
    assert 0 < sum(g != e for g, e in zip(greedy, exact)) < len(words)
    assert table.encode_words(words) == exact
    long = "".join(rng.choice("etaoin") for _ in range(400)).encode()
    assert table.encode_words([long]) == [table.merge_exactly(long)]


def test_bpe_round_trip_query(odd_docs, odd_texts, no_docs, byte_tokenizer):
    rows = bpe.round_trip(odd_docs, P.path("byte_bpe_50k.json")).collect()
    ids = [(k, byte_tokenizer.encode(t or "", add_special_tokens=False).ids) for k, t in odd_texts]
    expected = sorted((str(k), len(i), hashlib.sha256(",".join(map(str, i)).encode()).hexdigest(),
                       hashlib.sha256((t or "").encode()).hexdigest()) for (k, i), (_, t) in zip(ids, odd_texts))
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in rows) == expected
    kept = bpe.encoded(odd_docs, P.path("byte_bpe_50k.json")).collect()
    assert sorted((str(r.doc_id), r.ids) for r in kept) == sorted((str(k), i) for k, i in ids)
    assert bpe.round_trip(no_docs, P.path("byte_bpe_50k.json")).collect() == []


@pytest.mark.parametrize("length", [64, 4096])
def test_packing_is_whole_and_tight(odd_docs, odd_texts, no_docs, length):
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    t.no_truncation()
    t.no_padding()
    expected = sorted((str(k), tuple(t.encode(x or "", add_special_tokens=False).ids) + (2,)) for k, x in odd_texts)
    costs = packing.Costs(length=length, stride=min(256, length // 4), closest=min(16, length // 8))
    rows = packing.pack(odd_docs.where("doc_id is not null and doc_id <> 18"), P.path("word_bpe_49k.json"), costs=costs).collect()
    docs, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        docs[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    of = {k: ids for k, ids in expected if k not in ("None", "18")}
    assert {str(k) for k in docs} == set(of)
    for k, pieces in docs.items():
        at = 0
        for r in sorted(pieces, key=lambda r: r.start):
            ids = of[str(k)]
            assert r.start == at and r.doc_tokens == len(ids)
            assert zlib.crc32(np.array(ids[at:at + r.length], "<u4").tobytes()) == r.ids_crc32
            at += r.length
        assert at == len(of[str(k)])
    padding = 0
    for pieces in sequences.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= length
        padding += 0 if at & (at - 1) == 0 else length - at
    assert padding <= costs.stride / length * sum(map(len, of.values()))   # cuts are about a stride apart at most
    assert packing.pack(no_docs, P.path("word_bpe_49k.json")).collect() == []


def test_packing_plan_is_optimal():
    """The queue's plan against all plans, on short streams: least padding plus penalties."""
    rng = random.Random(3)
    costs = packing.Costs(length=16, sentence=2.0, inside=5.0, stride=4, closest=1)
    for _ in range(40):
        packer = packing.Packer(costs, 0)
        cuts = []
        at = 0
        for _ in range(rng.randint(2, 5)):
            n = rng.randint(1, 9)
            ends = sorted(rng.sample(range(1, n + 1), rng.randint(0, min(n, 2))))
            list(packer.add(0, np.zeros(n, np.uint32), np.array(ends, np.int64)))
            cuts += [(at + e, costs.sentence) for e in ends if e < n] + [(at + n, 0.0)]
            at += n
        if any(b - a > 6 for (a, _), (b, _) in zip([(0, 0.0), *cuts], cuts)):
            continue
        best = {0: 0.0}
        for position, penalty in cuts:
            best[position] = min(c + costs.length - (position - p) + penalty for p, c in best.items() if 0 < position - p <= 16)
        planned = {p: v - p for p, v in zip(packer.cuts, packer.value)}
        assert all(abs(planned[p] - c) < 1e-9 for p, c in best.items())


def test_packing_survives_a_second_run(odd_docs):
    first, second = (sorted(map(str, packing.pack(odd_docs, P.path("word_bpe_49k.json")).collect())) for _ in range(2))
    assert first == second


def test_toxicity_folding_and_exceptions():
    m = toxicity.Lexicon({"idiot": 4.0, "trash": 3.0, "lowei*": 2.0}, ["trash can"], 1.0).matcher()
    for text in ("You IDIOT!", "1d10t", "іdiоt", "ídíöt", "id­iot", "ｉｄｉｏｔ", "$o an id!ot"):
        assert m.score(text) > 0, text
    for text in ("", None, "idiotic", "a trash can", "xlowei", "perfectly clean"):
        assert m.score(text) == 0, text
    assert m.score("loweischaft") > 0 and m.score("trash") > m.score("trash " + "clean " * 500) > 0


def test_toxicity_learns(spark, odd_docs, no_docs):
    rng = random.Random(8)
    rows, labels = [], []
    for i in range(600):
        toxic = i % 5 == 0
        w = [rng.choice("alpha beta gamma delta rho sigma tau phi".split()) for _ in range(rng.randint(5, 80))]
        if toxic:
            for _ in range(2):
                w.insert(rng.randrange(len(w)), rng.choice(["grumbled", "blasted"]) + rng.choice(["", "x", "y"]))
        rows.append((i, " ".join(w)))
        labels.append((i, int(toxic)))
    labels += [(None, 1), (7, None), (10**6, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame(labels, "doc_id long, toxic int")
    lexicon = toxicity.fit(docs, marks)
    got = {r.doc_id: r.score >= 0.5 for r in toxicity.scored(docs, lexicon).collect()}
    held = [i for i, _ in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert held and all(got[i] == (i % 5 == 0) for i in held)
    assert toxicity.keep_clean(docs, lexicon).count() == sum(not v for v in got.values())
    assert toxicity.keep_clean(odd_docs, lexicon).columns == odd_docs.columns
    assert toxicity.scored(odd_docs, lexicon).count() == odd_docs.count()
    assert toxicity.scored(no_docs, lexicon).collect() == []
    none = toxicity.fit(docs, marks.where("false"))
    assert none.matcher().score("you idiot") >= 0.5 and none.matcher().score("fine") == 0


def test_toxicity_keeps_the_ratio_of_the_labels(spark):
    """A word in 9 of 10 toxic and 1 of 10 clean texts is not precise at 1 toxic to 20 clean, sampled or not."""
    rows, labels = [], []
    for i in range(2100):
        toxic = i % 21 == 0
        w = [f"n{i}"] + (["meh"] if ((i // 21) % 10 > 0 if toxic else i % 10 == 3) else []) + (["grumbled"] if toxic else [])
        rows.append((i, " ".join(w)))
        labels.append((i, int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame(labels, "doc_id long, toxic int")
    for sample in (20_000, 70):
        assert set(toxicity.fit(docs, marks, toxicity.Settings(sample=sample)).weights) & {"meh", "grumbled"} == {"grumbled"}
    texts = [("bad", 1)] * 3 + [("bad", 0)] * 2 + [("fine", 0)] * 10
    sample, lexicon = spark.createDataFrame(texts, "text string, toxic int"), toxicity.Lexicon({"bad": 2.0})
    x = lexicon.matcher().x("bad")
    assert toxicity._best_cut(sample, lexicon, (1.0, 1.0)) < x < toxicity._best_cut(sample, lexicon, (8.0, 1.0))


def test_licence_rules(spark, odd_docs, no_docs):
    texts = [(1, "Some code.\nReleased under the MIT License.\nmore"), (2, None), (3, "Apache License, Version 2.0."),
             (4, "Apache License, Version 2.0.\nfoo. You may not use this file except in compliance with the License."),
             (5, "Licensed under CC BY-NC 4.0. Licensed under CC BY-NC 4.0."), (6, ""), (6, "All rights reserved!")]
    got = sorted((r.doc_id, r.licences, r.n_sentences) for r in
                 licences.scan(spark.createDataFrame(texts, "doc_id long, text string")).collect())
    assert got == [(1, "MIT", 1), (2, "", 0), (3, "", 1), (4, "Apache-2.0", 2), (5, "CC-BY-NC-4.0", 2), (6, "", 0), (6, "", 1)]
    assert licences.scan(odd_docs).count() == odd_docs.count() and licences.scan(no_docs).collect() == []


MIT = """The MIT License (MIT)

Copyright (c) 2020 Some One

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."""
APACHE = """Licensed to the Foundation under one or more agreements. The Foundation licenses
this file to You under the Apache License, Version 2.0
(the "License"); you may not use this file except in compliance with
the License.  You may obtain a copy of the License at

   http://www.apache.org/licenses/LICENSE-2.0"""
GPL = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details.

You should have received a copy of the GNU General Public License
along with this program.  If not, see <https://www.gnu.org/licenses/>."""
BSD = """BSD 3-Clause License

Copyright (c) 2020, Some One
All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:"""


@pytest.mark.parametrize("mark,end", [("", "\n"), (" * ", "\n"), ("# ", "\r\n"), ("// ", "\n")])
def test_wrapped_licences(spark, mark, end):
    whole = {"MIT": MIT, "Apache-2.0": APACHE, "GPL-3.0-or-later": GPL, "BSD-3-Clause": BSD}
    rows = [(i, "int x;\n" + end.join((mark + line).rstrip() for line in t.split("\n")) + "\nint y;") for i, t in enumerate(whole.values())]
    rows += [(10, 'Licensed under the Apache License, Version 2.0 (the "License");'), (11, "This is not released under the MIT License."),
             (12, MIT.replace("\n", " ")), (13, "It is the MIT" + end * 2 + "License"), (14, "no full stop" + end + mark + "Licensed under CC BY 4.0")]
    got = {r.doc_id: r.licences for r in licences.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == dict(enumerate(whole)) | {10: "Apache-2.0", 11: "", 12: "MIT", 13: "", 14: "CC-BY-4.0"}


BSD2 = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that
the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following
disclaimer in the documentation and/or other materials provided with the distribution.
"""
ENDORSE = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote
products derived from this software without specific prior written permission.
"""
DISCLAIMER = "\nTHIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES"
GNU_GRANT = ("This library is free software; you can redistribute it and/or\nmodify it under the terms of the GNU Lesser General Public\n"
             "License as published by the Free Software Foundation; either\nversion 2.1 of the License, or (at your option) any later version.")


@pytest.mark.parametrize("text,licences_", [
    ("no longer released under the MIT License", ""),
    ("This isn't licensed under the MIT license.", ""),
    ("Neither the code nor its manuals are licensed under CC BY 4.0.", ""),
    ("It is not, and never was, licensed under the Apache License, Version 2.0.", ""),
    ("not not not was was licensed under CC BY 4.0", ""),
    ("It is not for sale. It is licensed under CC BY 4.0.", "CC-BY-4.0"),
    ("If not otherwise stated, text is licensed under CC BY 4.0.", "CC-BY-4.0"),
    ("It is not only licensed under CC BY 4.0.", "CC-BY-4.0"),
    ("Not licensed under CC BY 4.0 but released under the MIT License", "MIT"),
    ("neither " * 3000 + "licensed under CC BY 4.0", ""),
    ("not " + "was " * 20_000, ""),
    (BSD2 + DISCLAIMER, "BSD-2-Clause"),
    (BSD2 + ENDORSE + DISCLAIMER, "BSD-3-Clause"),
    (BSD2.split("\n\n")[0], ""),
    (GNU_GRANT.replace("Foundation; either", "Foundation, either"), "LGPL-2.1-or-later"),
    ("// SPDX-License-Identifier: MIT", "MIT"),
    ("# SPDX-License-Identifier: GPL-3.0-or-later", "GPL-3.0-or-later"),
    ("# SPDX-License-Identifier: MIT-0", "MIT-0"),
    ("This is free and unencumbered software released into the public domain.", "Unlicense"),
    ("This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy of the MPL was not distributed with\n"
     "this file, You can obtain one at http://mozilla.org/MPL/2.0/.", "MPL-2.0"),
    ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.", "0BSD"),
    ("Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, provided "
     "that the above\ncopyright notice and this permission notice appear in all copies.", "ISC"),
])
def test_denied_and_further_licences(spark, text, licences_):
    [row] = licences.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert row.licences == licences_
