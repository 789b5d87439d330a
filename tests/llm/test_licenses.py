"""License scans: every rule on a text of its own, and the base columns against a plain computation."""

import re
from re import _parser as parser

from docweave.llm import licenses


def sample(tree, branch):
    """Text that a parsed pattern matches, taking the given alternative wherever there is one."""
    out = b""
    for op, value in tree:
        op = str(op)
        if op == "LITERAL":
            out += bytes([value])
        elif op in ("NOT_LITERAL", "ANY"):
            out += b"x"
        elif op == "IN":
            kind, first = value[0]
            kinds = [(str(k), str(v)) for k, v in value]
            if any("CATEGORY_SPACE" in v or (k, v) == ("LITERAL", "32") for k, v in kinds) or "NOT_WORD" in str(first):
                out += b" "
            else:
                out += bytes([first]) if str(kind) == "LITERAL" else bytes([first[0]]) if str(kind) == "RANGE" else b"1" if "DIGIT" in str(first) else b"a"
        elif op == "BRANCH":
            out += sample(value[1][min(branch, len(value[1]) - 1)], branch)
        elif op in ("MAX_REPEAT", "MIN_REPEAT"):
            least, most, inner = value
            out += sample(inner, branch) * (least if branch == 0 else min(most, max(least, 1)))
        elif op == "SUBPATTERN":
            out += sample(value[3], branch)
        elif op not in ("AT", "ASSERT_NOT"):
            raise ValueError(op)
    return out


def test_every_rule_and_alternative_wins_on_its_own_sample():
    n = 0
    for words, group in licenses.rules():
        for rule in group:
            for branch in range(4):
                text = b"x. " + sample(parser.parse(rule.pattern.pattern), branch) + b" ."
                assert all(w in text for w in words), (rule.label, text)
                assert rule.label in [x[2] for x in licenses.detections(text)], (rule.label, text)
            n += 1
    assert n >= 270


def test_spdx_tags_and_short_spellings():
    labels = lambda t: [x[2] for x in licenses.detections(t.encode())]
    assert labels("spdx-license-identifier: apache-2.0\n") == ["apache-2.0"]
    assert labels("# spdx-license-identifier: mit") == ["mit"]
    assert labels("spdx-license-identifier: gpl-3.0-or-later") == ["gpl-3.0"]
    assert labels("spdx-license-identifier: something-1.0") == ["spdx"]
    assert labels("gnu general public license v2") == ["gpl-2.0"] and labels("general public license v.3") == ["gpl-3.0"]
    assert labels("apache license, v2.0") == ["apache-2.0"] and labels("mozilla public license v2.0") == ["mpl-2.0"]
    assert labels("openrail") == ["openrail-m"] and labels("zero-clause bsd") == ["0bsd"]


def base(text):
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    at = [(i, label) for phrase, label in licenses.BASE.items() for p in [phrase.split()] for i in range(len(words)) if words[i : i + len(p)] == p]
    places = [i for i, _ in at]
    return len(words), len(at), min(places, default=None), max(places, default=None), ",".join(sorted({x for _, x in at}))


def test_base_columns_equal_brute_force(spark):
    texts = [
        None, "", "cc by cc by", "CC-BY 4.0, all rights reserved. GENERAL public\nLICENSE", "all rights all rights reserved reserved", "ccby cc. by É cc by", "general public licence", "x " * 50_000 + "cc by",
        "All Rights Reserved", "All Rights Reserved",
    ]
    docs = spark.createDataFrame([(i if i else None, t, "x", 1) for i, t in enumerate(texts)], "doc_id long, text string, labels string, n_words int")
    got = {r.doc_id or 0: (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in licenses.license_report(docs).collect()}
    assert got == {i: base(t) for i, t in enumerate(texts)}
