"""Licence scan: a trained paragraph classifier in DataFrame operations.

A paragraph is a line, or several lines that were wrapped at a column: blank lines part paragraphs, and a line goes on in
the next one if that line's first word would not have fitted into the width of its block (see scan()).

A multinomial logistic regression over word 1- and 2-grams, made sparse by an L1 penalty, gives a licence family to each
paragraph, or `unknown`. It is trained here, on the driver, from the public notices below, shortened and mixed by rule, and
from licences of other families and sentences that are no notices, which are `unknown`. Calibration takes paragraphs that a
model has not seen: notices are left out in turns, with all that is made of them, and a temperature is fitted to what the
models of the rest say of them. A paragraph below LEAST is unknown too. The prediction is confirmed if a notice of that family
is in the paragraph with enough of its word pairs.

Features have a word that ordinary sentences do not use; a paragraph without one has the score of an empty one, `unknown`,
and one array intersection tells. Weights are looked up by hash in a table without collisions. All of it is fixed after
training, a few hundred kilobytes, whatever the corpus holds.
"""

from __future__ import annotations

import json
import re
import struct
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

UNKNOWN = "unknown"
#: Least probability of a family, and least share of word pairs in common with a notice that confirms it.
LEAST, CONFIRM = 0.5, 0.8
#: Columns that wrapped lines have at most, and lines that are left out of training for calibration: one in FOLDS in each turn.
WRAP, FOLDS = 100, 3
#: What a line that ends a sentence ends in, and comment marks before its first word.
ENDS, SIGNS = "[.!?][ ]*$", "^[ #*/;%>|-]+"

#: Public licence notices by family, fixed values.
NOTICES: dict[str, list[str]] = {
    "apache": [
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "This project is released under the Apache 2.0 license.",
        "SPDX-License-Identifier: Apache-2.0",
        "Apache License Version 2.0, January 2004",
        "You may obtain a copy of the License at https://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
        "Licensed to the Apache Software Foundation (ASF) under one or more contributor license agreements. See the NOTICE file distributed with this work for additional information regarding copyright ownership. The ASF licenses this file to you under the Apache License, Version 2.0",
        "This file is available under the Apache-2.0 license.",
    ],
    "mit": [
        "Released under the MIT License.",
        "This project is under MIT.",
        "Licensed under the MIT license.",
        "This software is distributed under the terms of the MIT License.",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction',
        "SPDX-License-Identifier: MIT",
        "The MIT License (MIT)",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
        "Available under the MIT license, see the LICENSE file.",
    ],
    "gpl": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "Released under the GNU GPL v2 or later.",
        "Licensed under the GPLv3.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
        "You should have received a copy of the GNU General Public License along with this program.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
        "You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.",
        "SPDX-License-Identifier: GPL-2.0-only",
        "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
    ],
    "lgpl": [
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or any later version.",
        "Licensed under the GNU Lesser General Public License, version 3.",
        "Released under the LGPL v3.",
        "SPDX-License-Identifier: LGPL-2.1-only",
        "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.",
        "You should have received a copy of the GNU Lesser General Public License along with this library.",
        "This work is licensed under the GNU Lesser General Public License, version 2.1.",
    ],
    "agpl": [
        "Licensed under the GNU Affero General Public License, version 3.",
        "This program is distributed under the terms of the GNU Affero General Public License as published by the Free Software Foundation.",
        "Released under the AGPL v3.",
        "SPDX-License-Identifier: AGPL-3.0-only",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU Affero General Public License along with this program.",
    ],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Licensed under the BSD 3-Clause License.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "SPDX-License-Identifier: BSD-2-Clause",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
        "Released under the BSD license.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ],
    "mpl": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License, version 2.0.",
        "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
        "SPDX-License-Identifier: MPL-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    ],
    "cc-by": [
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "Licensed under CC BY 4.0.",
        "Text is available under the Creative Commons Attribution License, CC BY 3.0.",
        "SPDX-License-Identifier: CC-BY-4.0",
        "Released under a Creative Commons Attribution 3.0 license.",
        "This article is distributed under the terms of the Creative Commons Attribution 4.0 International License (CC BY).",
    ],
    "cc-by-sa": [
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "Licensed under CC BY-SA 4.0.",
        "Text is available under the Creative Commons Attribution-ShareAlike License, CC BY-SA 3.0.",
        "SPDX-License-Identifier: CC-BY-SA-4.0",
        "Released under the Creative Commons Attribution-ShareAlike license.",
    ],
    "cc-by-nc": [
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "Licensed under CC BY-NC 4.0.",
        "Shared under the Creative Commons Attribution-NonCommercial License, CC BY-NC-ND 4.0.",
        "Licensed under CC BY-NC-SA 4.0.",
        "SPDX-License-Identifier: CC-BY-NC-4.0",
        "Released under a Creative Commons Attribution-NonCommercial license.",
    ],
    "public-domain": [
        "This work is dedicated to the public domain under CC0 1.0 Universal.",
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work (CC0).",
        "This is free and unencumbered software released into the public domain.",
        "SPDX-License-Identifier: Unlicense",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
        "This file is in the public domain.",
        "SPDX-License-Identifier: CC0-1.0",
    ],
    "proprietary": [
        "All rights reserved.",
        "Copyright (c) 2020 Example Company. All rights reserved.",
        "No part of this publication may be reproduced, distributed, or transmitted in any form without the prior written permission of the publisher.",
        "Proprietary and confidential. Unauthorized copying of this file is strictly prohibited.",
        "This document is confidential and proprietary. All rights reserved worldwide.",
        "Copyright 2019 by the publisher. All rights are reserved. No reproduction without written permission.",
    ],
}
#: Notices of licences of no family here, fixed values: `unknown`.
OTHERS = [
    "Licensed under the European Union Public Licence, version 1.2.",
    "SPDX-License-Identifier: EUPL-1.2",
    "The contents of this file are subject to the terms of the Common Development and Distribution License (the License).",
    "SPDX-License-Identifier: CDDL-1.0",
    "This Font Software is licensed under the SIL Open Font License, Version 1.1.",
    "Released under the zlib license.",
    "SPDX-License-Identifier: Zlib",
    "This software is released under the PostgreSQL License.",
    "Licensed under the PHP License, version 3.01.",
    "This source file is subject to version 3.0 of the PHP license.",
    "Licensed under the Academic Free License version 3.0.",
    "SPDX-License-Identifier: AFL-3.0",
    "Licensed under the Microsoft Public License (Ms-PL).",
    "This work is licensed under the Open Database License, version 1.0.",
    "Released under the WTFPL, version 2.",
    "SPDX-License-Identifier: WTFPL",
    "Distributed under the Python Software Foundation License, version 2.",
    "This program is made available under the terms of the Common Public License, version 1.0.",
    "Licensed under the IBM Public License Version 1.0.",
    "Released under the Vim license.",
    "Licensed under the Q Public License, version 1.0.",
    "This software is available under the Sleepycat License.",
    "Licensed under the LaTeX Project Public License, version 1.3c.",
    "SPDX-License-Identifier: OpenSSL",
    "Released under the Beerware License.",
    "Distributed under the Ruby License, see the file COPYING.",
]
#: Sentences that are no notices, fixed values. The first group sets the words that are ordinary, and must not hold
#: a name of a family; the second uses words of notices, German "mit" among them, which its neighbours tell apart.
PLAIN = [
    "The weather was fine and we walked along the river until the sun went down.",
    "In this version of the story the captain comes home with all of his men.",
    "You may use the side door if the front one is closed, or ring the bell.",
    "This work is hard but it is free of danger to any person with some care.",
    "She said that the file was on the table, along with a copy of the letter.",
    "The following day they found that the source of the noise was a small bird.",
    "Either of you can come with us, and the others can wait for the next one at the station.",
    "It is not part of the plan to have more people in the house without their name on the list.",
    "By the end of the year 2.0 million people in 3 or 4 regions had at least one of these.",
    "As a rule, what is said under such conditions should not be taken as the final word.",
    "They should have been there at 1 or 2, but no one had any later information about it.",
    "He did all he could to make the public aware of this, and all that he got was a shrug.",
    "There are only a few of its kind left, and those were seen before or after your last visit, if at all.",
    "We need a good text in the form that the author gave it, and the style of a project or program is related to it by law.",
    "Sie kam dem Zug in der Stadt nach, und er fuhr das Rad die Allee hinab, aber nur bis zum Fluss.",
    "Ein Mann und eine Frau sind von einem Haus zu einer Wiese gegangen, den Hund an der Leine, und er hat sich sehr gefreut.",
    "Elle est venue de la gare sans bagages, et les autres avaient pris le bus pour la ville.",
    "La casa era de su padre, y los dos fueron a verla por la tarde con sus amigos.",
]
HARD = [
    "His driving license was revoked after the accident.",
    "You need a fishing license in this county.",
    "The court ruled that the copyright of the song belongs to the heirs.",
    "Apache helicopters were seen over the valley.",
    "The Apache people live in the southwest.",
    "She studied physics at MIT before the war.",
    "The general public was not admitted.",
    "The software was released in May to good reviews.",
    "The creative team has many things in common.",
    "Permission to land was granted to the crew.",
    "Attribution of the painting is disputed.",
    "The seats in this row are reserved.",
    "All seats are reserved, and the right to refuse entry with them.",
    "Licensed under the Example Community License.",
    "Please read the license of the product before you install the software.",
    "The film was distributed by a small company.",
    "Mozilla makes a browser. The source is open.",
    "The library is free and open to any person.",
    "A gnu is a large antelope of the African plains.",
    "The domain of the function is the set of real numbers.",
    "The foundation was published in the journal of free thought.",
    "Unauthorized persons are prohibited from the area.",
    "Modification of the house needs a permit.",
    "Redistribution of wealth was the main theme of the debate.",
    "Warranty claims must be made in writing.",
    "Sie kam mit dem Zug in die Stadt, und er fuhr mit dem Rad, aber nur bis zum Fluss.",
    "Ein Mann mit einem Hund und eine Frau mit einer Leine sind mit der Stadt und mit den Haus gegangen.",
    "Er hat sich mit einer Frau gefreut, und sie kam mit ein und mit eine und mit die Wiese.",
    "Und mit dem Hund, und er mit der Frau, hat mit den Mann und sich mit das und zu mit von.",
    "Nur mit dem Rad aber mit dem Zug, bis mit der Allee, sehr mit und in mit die.",
]


def tokens(text: str) -> list[str]:
    return [w for w in re.split("[^a-z0-9]+", text.lower()) if w]


def grams(words: list[str]) -> list[str]:
    """Distinct words and word pairs, in order."""
    return list(dict.fromkeys(words + [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)]))


def _examples(seed: int = 7) -> tuple[list[list[str]], list[str], list[int]]:
    """Words, family and source of notices and other sentences: whole, shortened, and inside of ordinary ones, by rule.

    The source is the number of the notice that an example was made of; the first one of each source is the notice itself.
    """
    rng = np.random.default_rng(seed)
    plain = [tokens(s) for s in PLAIN]
    made: list[tuple[list[str], str, int]] = []
    texts = [(f, t) for f, group in [*NOTICES.items(), (UNKNOWN, OTHERS + HARD + PLAIN)] for t in group]
    for source, (family, text) in enumerate(texts):
        words = tokens(text)
        made.append((words, family, source))
        for k in range(6):
            keep = [w for w in words if rng.random() > 0.12]
            around = plain[rng.integers(len(plain))] if k % 2 else []
            cut = int(rng.integers(len(around) + 1))
            if len(keep) >= max(2, 0.7 * len(words)):
                made.append((around[:cut] + keep + around[cut:], family, source))
    made += [(p[: int(n)], UNKNOWN, -1) for p in plain for n in rng.integers(1, 12, 6)]
    return [list(x) for x in zip(*made, strict=True)]


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _fit(x: np.ndarray, y: np.ndarray, penalty: float = 2e-4, rounds: int = 200) -> tuple[np.ndarray, np.ndarray]:
    """Weights and bias of the logistic regression with an L1 penalty: accelerated proximal gradient."""
    n = len(x)
    v = np.ones(x.shape[1], x.dtype)
    for _ in range(20):  # the largest singular value
        v = x.T @ (x @ v)
        v /= np.linalg.norm(v)
    step = 3.6 * n / (np.linalg.norm(x @ v) ** 2 + n)
    w = v = np.zeros((x.shape[1], y.shape[1]), x.dtype)
    b = c = np.zeros(y.shape[1], x.dtype)
    t = 1.0
    for _ in range(rounds):
        g = (_softmax(x @ v + c) - y) / n
        w_new = v - step * (x.T @ g)
        w_new = np.sign(w_new) * np.maximum(0, np.abs(w_new) - step * penalty)
        b_new = c - step * g.sum(axis=0)
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, c = w_new + (t - 1) / t_new * (w_new - w), b_new + (t - 1) / t_new * (b_new - b)
        w, b, t = w_new, b_new, t_new
    return w, b


@lru_cache(maxsize=1)
def model() -> dict:
    """families, bias and temperature, the weights of each feature that has any, and the share of unseen notices that the
    models without them named rightly: trained once per driver, in seconds."""
    common = {w for s in PLAIN for w in tokens(s)}
    words, labels, source = _examples()
    vocabulary = sorted({g for w in words for g in grams(w) if any(x not in common for x in g.split(" "))})
    column = {g: k for k, g in enumerate(vocabulary)}
    families = [*NOTICES, UNKNOWN]
    x = np.zeros((len(words), len(vocabulary)))
    for k, r in enumerate(words):
        x[k, [column[g] for g in grams(r) if g in column]] = 1
    at, source = np.array([families.index(f) for f in labels]), np.array(source)
    y = np.eye(len(families))[at]
    logits, truth = [], []
    whole = np.flatnonzero((source >= 0) & (np.concatenate([[-1], source[:-1]]) != source))
    for turn in range(FOLDS):
        out = (source % FOLDS == turn) & (source >= 0)
        w, b = _fit(x[~out], y[~out])
        unseen = whole[out[whole]]
        logits.append(x[unseen] @ w + b)
        truth.append(at[unseen])
    logits, truth = np.concatenate(logits), np.concatenate(truth)
    heats = np.geomspace(0.25, 8, 41)
    heat = float(heats[np.argmin([-np.log(_softmax(logits / h)[np.arange(len(truth)), truth] + 1e-12).sum() for h in heats])])
    w, b = (np.round(a, 6) for a in _fit(x, y))
    used = np.flatnonzero(np.abs(w).sum(axis=1) > 0)
    right = float((logits.argmax(axis=1) == truth).mean())
    return {"families": families, "bias": b.tolist(), "heat": round(heat, 6), "weights": {vocabulary[k]: w[k].tolist() for k in used}, "unseen": right}


def _notice_pairs() -> dict[str, list[list[str]]]:
    """The word pairs of each notice (the words of a notice of one word)."""
    return {f: [list(dict.fromkeys(f"{a} {b}" for a, b in zip(w, w[1:], strict=False))) or w for w in map(tokens, group)] for f, group in NOTICES.items()}


def hash_of(gram: str) -> int:
    """Spark's xxhash64 of a string."""
    from xxhash import xxh64_intdigest

    h = xxh64_intdigest(gram.encode(), 42)
    return h - (1 << 64) if h >> 63 else h


def _slot(shift: int, h: int, size: int) -> int:
    """pmod(xxhash64(shift, h), size) as Spark has it, of an int and a long."""
    from xxhash import xxh64_intdigest

    x = xxh64_intdigest(struct.pack("<q", h), xxh64_intdigest(struct.pack("<i", shift), 42))
    return (x - (1 << 64) if x >> 63 else x) % size


@lru_cache(maxsize=1)
def table() -> tuple[list[int], list[int], list[str]]:
    """A hash table of the features without collisions: a shift for each bucket, then the hash and the feature of each slot."""
    known = sorted(model()["weights"])
    size = 1 << max(4, (2 * len(known)).bit_length())
    buckets: dict[int, list[str]] = {}
    for g in known:
        buckets.setdefault(hash_of(g) % (size // 4), []).append(g)
    shifts, keys, names = [0] * (size // 4), [0] * size, [""] * size
    for bucket, group in sorted(buckets.items(), key=lambda e: (-len(e[1]), e[0])):
        shift = 0
        while True:
            slots = [_slot(shift, hash_of(g), size) for g in group]
            if len(set(slots)) == len(slots) and not any(names[s] for s in slots):
                break
            shift += 1
        shifts[bucket] = shift
        for s, g in zip(slots, group, strict=True):
            keys[s], names[s] = hash_of(g), g
    return shifts, keys, names


def _telling() -> list[str]:
    """Words of features that ordinary sentences do not use: every feature has one."""
    common = {w for s in PLAIN for w in tokens(s)}
    return sorted({w for g in model()["weights"] for w in g.split(" ")} - common)


def _literal(value: object, kind: str) -> Column:
    """A constant of the plan from JSON."""
    return F.from_json(F.lit(json.dumps(value)), kind)


def _once(**columns: Column) -> Column:
    """A struct that is computed once, where later steps use it more than once."""
    return F.explode(F.array(F.struct(*[c.alias(k) for k, c in columns.items()]))).alias("x")


def paragraphs(df: DataFrame) -> DataFrame:
    """(id, paragraph, text) of the paragraphs with a letter or digit of `df` (id, text), numbered from 0 in a text."""
    blocks = df.select("id", F.posexplode(F.split("text", "\n[ \\t]*\n+")).alias("block", "text"))
    lines = blocks.select("id", "block", _once(lines=F.split("text", "\n"))).select("id", "block", "x.lines")
    lines = lines.select("id", "block", _once(lines=F.col("lines"), width=F.array_max(F.transform("lines", F.char_length)))).select("id", "block", "x.*")

    def full(i: Column) -> Column:
        """Would the first word of the line after line i not have fitted into line i."""
        word = F.substring_index(F.regexp_replace(F.get("lines", i + 1), SIGNS, ""), " ", 1)
        return (i >= 0) & (F.char_length(F.get("lines", i)) + 1 + F.char_length(word) > F.col("width"))

    open_ = lambda i: full(i) & ~F.get("lines", i).rlike(ENDS)
    goes_on = lambda line, i: F.coalesce(open_(i) | full(i) & open_(i - 1), F.lit(False))
    joined = F.split(F.array_join(F.transform("lines", lambda line, i: F.concat(line, F.when(goes_on(line, i), " ").otherwise("\n"))), ""), "\n")
    units = F.when((F.size("lines") > 1) & (F.col("width") <= WRAP), joined).otherwise(F.col("lines"))
    units = lines.select("id", "block", units.alias("units"))
    whole = F.filter("units", lambda u: u.rlike("[A-Za-z0-9]"))
    return units.select("id", "block", F.posexplode(whole).alias("paragraph", "text"))


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All paragraphs of `df` with a letter or digit: id, block, paragraph, family, probability, similarity, confirmed.

    block: the number, from 0, of the part of the text between blank lines; paragraph: from 0 within it. Lines of a block of at
    most WRAP columns are joined where a line was wrapped: the next line's first word would not have fitted into the width
    of the block, and that line, or the wrapped one before it, does not end a sentence. family is `unknown`
    where the classifier says so or is less than LEAST sure. Probability is that of the most likely class; similarity is
    the largest share of the word pairs of a notice of the likeliest family that the paragraph holds, 0 without features.
    Null and empty texts have no rows; rows that repeat are scanned each; other columns are not read. An empty table gives an empty one.
    """
    m = model()
    shifts, keys, names = table()
    families = m["families"]
    docs = df.select(df[id_col].alias("id"), df[text_col].alias("text"))
    rows = paragraphs(docs).select("id", "block", "paragraph", _once(words=F.array_remove(F.split(F.lower("text"), "[^a-z0-9]+"), ""))).select("id", "block", "paragraph", "x.words")
    # Hashes of words and word pairs, where there is a telling word.
    pairs = F.transform(F.slice("words", 1, F.size("words") - 1), lambda w, i: F.xxhash64(F.concat_ws(" ", w, F.get("words", i + 1))))
    tells = F.arrays_overlap("words", _literal(_telling(), "array<string>"))
    none = F.array().cast("array<bigint>")
    rows = rows.select("id", "block", "paragraph", _once(ones=F.when(tells, F.transform("words", lambda w: F.xxhash64(w))).otherwise(none), pairs=F.when(tells, pairs).otherwise(none))).select("id", "block", "paragraph", "x.*")
    slot = lambda h: F.pmod(F.xxhash64(F.get(_literal(shifts, "array<int>"), F.pmod(h, F.lit(len(shifts))).cast("int")), h), F.lit(len(keys))).cast("int")
    places = F.transform(F.concat("ones", "pairs"), lambda h: F.when(F.get(_literal(keys, "array<bigint>"), slot(h)) == h, slot(h)))
    there = F.array_sort(F.array_distinct(F.filter(places, lambda s: s.isNotNull())))
    own = F.when(F.size("pairs") > 0, F.col("pairs")).otherwise(F.col("ones"))
    rows = rows.select("id", "block", "paragraph", _once(own=own, there=there)).select("id", "block", "paragraph", "x.*")
    # Scores: the sum of the weight vectors of the features that are there, by slot.
    weights = _literal([m["weights"].get(g, []) for g in names], "array<array<double>>")
    start = F.array(*[F.lit(float(b)) for b in m["bias"]])
    score = F.aggregate("there", start, lambda acc, s: F.zip_with(acc, F.get(weights, s), lambda a, w: a + w))
    rows = rows.select("id", "block", "paragraph", "own", F.size("there").alias("n"), _once(score=score)).select("id", "block", "paragraph", "own", "n", "x.score")
    known = F.slice("score", 1, len(families) - 1)
    likeliest = F.array_position(known, F.array_max(known)).cast("int")
    probability = 1.0 / F.aggregate("score", F.lit(0.0), lambda acc, z: acc + F.exp((z - F.array_max("score")) / m["heat"]))
    # What no feature tells apart has the figures of an empty paragraph.
    empty = float(1 / np.exp((np.array(m["bias"]) - max(m["bias"])) / m["heat"]).sum())
    notices = _literal([[[hash_of(g) for g in p] for p in group] for group in _notice_pairs().values()], "array<array<array<bigint>>>")
    shared = F.array_max(F.transform(F.get(notices, likeliest - 1), lambda p: F.size(F.array_intersect(p, F.col("own"))) / F.size(p)))
    rows = rows.select(
        "id", "block", "paragraph",
        _once(
            probability=F.when(F.col("n") > 0, probability).otherwise(empty),
            best=F.when((F.col("n") > 0) & (F.array_max(known) > F.element_at("score", len(families))), F.element_at(F.array(*map(F.lit, families)), likeliest)).otherwise(UNKNOWN),
            similarity=F.when(F.col("n") > 0, F.round(shared, 6)).otherwise(0.0),
        ),
    ).select("id", "block", "paragraph", "x.*")
    family = F.when(F.col("probability") < LEAST, UNKNOWN).otherwise(F.col("best"))
    rows = rows.select("id", "block", "paragraph", family.alias("family"), "probability", "similarity")
    return rows.select(F.col("id").alias(id_col), "block", "paragraph", "family", F.round("probability", 6).alias("probability"), "similarity", ((F.col("family") != UNKNOWN) & (F.col("similarity") >= CONFIRM)).alias("confirmed"))


def oracle_sql() -> str:
    """The same scan in DuckDB SQL, with the trained weights as a table."""
    m = model()
    families = m["families"]
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    slots = {g: k for k, g in enumerate(table()[2]) if g}
    weights = ",\n".join(f"({slots[g]}, {quote(g)}, {c}, {w!r})" for g, row in m["weights"].items() for c, w in enumerate(row))
    bias = ", ".join(f"({c}, {quote(f)}, {b!r})" for c, (f, b) in enumerate(zip(families, m["bias"], strict=True)))
    notices = ",\n".join(f"({quote(f)}, [{', '.join(map(quote, p))}])" for f, group in _notice_pairs().items() for p in group)
    return f"""
WITH weight(k, gram, c, w) AS (VALUES {weights}),
class(c, family, bias) AS (VALUES {bias}),
notice(family, pairs) AS (VALUES {notices}),
block AS (
  SELECT row_id, doc_id, CAST(unnest(range(len(parts))) AS INTEGER) AS block, unnest(parts) AS part
  FROM (SELECT row_number() OVER () AS row_id, doc_id, regexp_split_to_array(text, '\n[ \t]*\n+') AS parts FROM documents)
),
lines AS (
  SELECT *, len(lines) AS n, list_max(list_transform(lines, lambda l: length(l))) AS width
  FROM (SELECT row_id, doc_id, block, string_split(part, chr(10)) AS lines FROM block)
),
wrapped AS (
  SELECT *, list_transform(range(1, n + 1), lambda i: i < n AND length(lines[i]) + 1 + length(string_split(regexp_replace(lines[i + 1], '{SIGNS}', ''), ' ')[1]) > width) AS fulls FROM lines
),
unit AS (
  SELECT row_id, doc_id, block, CASE WHEN n > 1 AND width <= {WRAP} THEN string_split(array_to_string(list_transform(range(1, n + 1), lambda i:
    lines[i] || CASE WHEN fulls[i] AND (NOT regexp_matches(lines[i], '{ENDS}') OR (i > 1 AND fulls[i - 1] AND NOT regexp_matches(lines[i - 1], '{ENDS}'))) THEN ' ' ELSE chr(10) END), ''), chr(10)) ELSE lines END AS units FROM wrapped
),
para AS (
  SELECT row_id, doc_id, block, CAST(unnest(range(len(units))) AS INTEGER) AS paragraph, unnest(units) AS text
  FROM (SELECT row_id, doc_id, block, list_filter(units, lambda u: regexp_matches(u, '[A-Za-z0-9]')) AS units FROM unit)
),
word AS (
  SELECT *, list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1]) AS pairs
  FROM (SELECT * EXCLUDE text, list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda x: x <> '') AS words FROM para)
),
gram AS (SELECT row_id, block, paragraph, unnest(list_distinct(words || pairs)) AS gram FROM word),
sums AS (SELECT row_id, block, paragraph, c, sum(w ORDER BY k) AS s FROM gram JOIN weight USING (gram) GROUP BY ALL),
score AS (SELECT row_id, block, paragraph, c, family, bias + s AS z FROM sums JOIN class USING (c)),
best AS (
  SELECT row_id, block, paragraph, arg_max(family, z) AS best, arg_max(family, z) FILTER (WHERE family <> '{UNKNOWN}') AS likeliest,
         1 / sum(exp((z - top) / {m["heat"]!r})) AS probability
  FROM (SELECT *, max(z) OVER (PARTITION BY row_id, block, paragraph) AS top FROM score) GROUP BY ALL
),
near AS (
  SELECT row_id, block, paragraph, best, likeliest, probability,
         max(len(list_intersect(notice.pairs, CASE WHEN len(word.pairs) > 0 THEN word.pairs ELSE words END)) / len(notice.pairs)) AS similarity
  FROM best JOIN word USING (row_id, block, paragraph) JOIN notice ON notice.family = likeliest GROUP BY ALL
),
none AS (SELECT 1 / sum(exp((bias - top) / {m["heat"]!r})) AS probability FROM (SELECT bias, max(bias) OVER () AS top FROM class)),
named AS (
  SELECT doc_id, block, paragraph, coalesce(near.probability, none.probability) AS probability, coalesce(round(similarity, 6), 0.0) AS similarity,
         CASE WHEN near.probability IS NULL OR near.probability < {LEAST} THEN '{UNKNOWN}' ELSE best END AS family
  FROM word LEFT JOIN near USING (row_id, block, paragraph) CROSS JOIN none
)
SELECT doc_id, block, paragraph, family, round(probability, 6) AS probability, similarity, family <> '{UNKNOWN}' AND similarity >= {CONFIRM} AS confirmed
FROM named
"""
