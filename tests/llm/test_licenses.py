import math
import re

import pytest

from storyloom.llm import license_texts, licenses


def judge(met, n_own, m):
    weights = dict(m.weights)
    z = [m.bias[c] + sum(weights[g][c] for g in sorted(met)) for c in range(len(m.classes))]
    top = max(z)
    k = z.index(top)
    total = sum(math.exp(x - top) for x in z)
    near = max(((len(met & set(own)) / n, len(met & set(own)), -t) for t, f, n, own in m.templates if f == m.classes[k]), default=None)
    p = 1 / total
    sure = near is not None and p >= licenses.CONFIDENT and (near[0] >= licenses.CONTAINED or near[1] >= licenses.LEAST_SHARED and near[1] >= licenses.INSIDE * n_own)
    return k, p, math.exp(z[-1] - top) / total, near, sure


def brute(rows, m):
    out, weights = [], dict(m.weights)
    for i, t in dict.fromkeys(rows):
        like = []
        for place, line in enumerate(re.split(r"\n(?: *\n)*", t or "")):
            grams = licenses.grams_of(line)
            met = {g for g in grams if g in weights}
            if met:
                c, p, none, near, _ = judge(met, len(grams), m)
                if none < 0.5:
                    like.append((place, place, met, len(grams), c if p >= licenses.CONFIDENT and near is not None and near[0] >= licenses.CONTAINED else None))
        parts, last = [], None
        for place, k, met, n, sure in like:
            if not parts or place != last + 1:
                parts.append([])
                family = None
            elif sure is not None and family is not None and sure != family:
                parts.append([])
            family = sure if sure is not None else family
            parts[-1].append((k, met, n))
            last = place
        for part in parts:
            c, p, _, near, sure = judge(set().union(*(x[1] for x in part)), sum(x[2] for x in part), m)
            if m.classes[c] != licenses.NONE:
                out.append((i, part[0][0], len(part), m.classes[c] if sure else "unknown", m.classes[c], round(p, 4), -near[2] if near else None, round(near[0], 4) if near else None, sure))
    return sorted(out, key=repr)


def scanned(df):
    rows = [(r.doc_id, r.paragraph, r.lines, r.family, r.predicted, round(r.probability, 4), r.template, None if r.contained is None else round(r.contained, 4), r.confirmed) for r in licenses.scan_licenses(df).collect()]
    return sorted(rows, key=repr)


def close(got, want):
    return len(got) == len(want) and all(a[:5] == b[:5] and abs(a[5] - b[5]) < 2e-4 and a[6] == b[6] and a[8] == b[8] for a, b in zip(got, want, strict=True))


def test_families_unknown_and_odd_rows(spark, odd_docs, no_docs):
    m = licenses.train_licenses()
    families = [f for f, texts in license_texts.TEXTS.items() for _ in texts]
    rows = [(100 + k, f"the of and\n{t}\nto in a") for k, t in enumerate(t for texts in license_texts.TEXTS.values() for t in texts)]
    rows += [(1, "Licensed under the Frobnicator License, edition 9."), (2, None), (3, ""), (4, "the driver showed a license at the gate"), (5, "the work of the people and the file"), (None, "All rights reserved.")]
    rows += [(6, "Released under the MIT License.")] * 2 + [(6, "x\nLicensed under CC BY 4.0."), (7, "Released under the MIT License.\nLicensed under CC BY-NC 4.0.\n\n \nAll rights reserved.")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as gram", "2 as class", "3 as paragraph", "4 as met", "5 as copy")
    got = scanned(df)
    assert close(got, brute(rows, m))
    for k, f in enumerate(families):
        assert [r[3] for r in got if r[0] == 100 + k] == [f]
    of = lambda i: [r[3] for r in got if r[0] == i]
    assert of(1) == ["unknown"] and of(4) == of(5) == of(2) == of(3) == [] and sorted(of(6)) == ["cc-by", "mit"] and of(7) == ["mit", "cc-by-nc", "proprietary"]
    assert scanned(no_docs) == scanned(odd_docs) == []


#: Notices as they stand in files: wrapped, in pieces or in other words than the texts that the model is trained on.
HELD_OUT = [
    ("apache", "Licensed under the Apache License, Version 2.0 (the \"License\");\nyou may not use this file except in compliance with the License.\nYou may obtain a copy of the License at\n\n    http://www.apache.org/licenses/LICENSE-2.0"),
    ("mit", "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR\nIMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,\nFITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE\nAUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER\nLIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,\nOUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE\nSOFTWARE."),
    ("bsd", "2. Redistributions in binary form must reproduce the above copyright notice,\nthis list of conditions and the following disclaimer in the documentation\nand/or other materials provided with the distribution."),
    ("isc", "Permission to use, copy, modify, and distribute this software for any\npurpose with or without fee is hereby granted, provided that the above\ncopyright notice and this permission notice appear in all copies."),
    ("epl", "are made available under the terms of the Eclipse Public License v2.0\nwhich is available at https://www.eclipse.org/legal/epl-2.0/"),
    ("gpl", "It is free software; you can redistribute it and/or modify it under the terms of the\nGNU General Public License as published by the Free Software Foundation, either version 2"),
    ("boost", "Distributed under the Boost Software License, Version 1.0.\n(See accompanying file LICENSE or copy at https://www.boost.org/LICENSE_1_0.txt)"),
    ("mpl", "/* This Source Code Form is subject to the terms of the Mozilla Public\n * License, v. 2.0. If a copy of the MPL was not distributed with this\n * file, You can obtain one at https://mozilla.org/MPL/2.0/. */"),
    ("cc-by-sa", "This page is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("lgpl", "This library is distributed in the hope that it will be useful,\nbut WITHOUT ANY WARRANTY; without even the implied warranty of\nMERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the GNU\nLesser General Public License for more details."),
    ("zlib", "This software is provided 'as-is', without any express or implied\nwarranty. In no event will the authors be held liable for any damages\narising from the use of this software."),
    ("public-domain", "This is free and unencumbered software released into the\npublic domain."),
]


def test_held_out_notices(spark):
    assert len(license_texts.TEXTS) >= 15
    rows = [(k, "the people of the city\n" + t + "\nand the work of the day") for k, (_, t) in enumerate(HELD_OUT)]
    got = scanned(spark.createDataFrame(rows, "doc_id long, text string"))
    found = {k: {r[3] for r in got if r[0] == k and r[8]} for k in range(len(HELD_OUT))}
    right = [k for k, (f, _) in enumerate(HELD_OUT) if found[k] == {f}]
    assert len(right) >= len(HELD_OUT) - 1, {HELD_OUT[k][0]: [r for r in got if r[0] == k] for k in range(len(HELD_OUT)) if k not in right}
    assert [r for r in got if r[8] and r[3] != HELD_OUT[r[0]][0]] == []


@pytest.mark.parametrize("text", ["the rights of the author", "she found a copy of the file", "conditions of the work", "the software is new and free", "Copyright office and license plates of the city"])
def test_prose_is_no_licence(spark, text):
    assert scanned(spark.createDataFrame([(1, text)], "doc_id long, text string")) == []


def test_probabilities_are_calibrated():
    """On paragraphs that were not trained on: the expected calibration error over ten bins."""
    m = licenses.train_licenses()
    place = {g: k for k, (g, _) in enumerate(m.weights)}
    import numpy as np

    texts, truth = zip(*licenses._paragraphs(3), strict=True)
    w = np.concatenate([np.array([v for _, v in m.weights]), np.zeros((1, len(m.classes)))])
    p = licenses._softmax(licenses._Rows(list(texts), place).times(w) + np.array(m.bias))
    top, right = p.max(1), p.argmax(1) == np.array(truth)
    assert right.mean() > 0.95
    bins = np.minimum((top * 10).astype(int), 9)
    error = sum(abs(top[bins == k].mean() - right[bins == k].mean()) * (bins == k).mean() for k in np.unique(bins))
    assert error < 0.03
