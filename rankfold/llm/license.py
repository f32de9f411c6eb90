"""License scan (operator 1): ordered signature rules over normalised words.

Everything is DataFrame expressions on one row: no Python on the executors, no
join and no shuffle, so a hot source or repeated rows cost nothing extra.

1. A text becomes its words (runs of digits, letters and non-ASCII characters,
   A-Z lower-cased), each with a blank on both sides.
2. Keyword prefilter: every rule needs one of its anchor words, which are taken
   from the words that its pattern requires. Plain substring searches look for
   all anchors; an anchor leads to its rules, a text without any is done.
3. Each of those rules (a regular expression over words) marks all its places.
4. Suppression: places are visited by start, longest first; a place inside an
   earlier one whose rule has the same or a higher priority is dropped.

The base phrases are counted separately at all places, suppressed or not.

A null text counts as empty: 0 words, no places, null positions, empty labels,
score 0. Overlapping places that tie (same interval, same priority) keep the
label that sorts first. Repeated rows give repeated rows. A text is scanned whole, however
long, in time linear in its places; an empty table gives an empty table; other columns
are not read.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: fixed values: base phrases and their labels
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: marks that the suppression fold appends before it moves them on
FOLD = 512
NOT_WORD = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

#: (label, preferred anchor word, names, short names); a name is a sequence of word patterns,
#: ``?`` after a word makes it optional
FAMILIES = [
    ("apache-2.0", "apache", ["apache software? license version? 2 0?"], ["apache 2 0?", "apache2"]),
    ("apache-1.1", "apache", ["apache software? license version? 1 1"], ["apache 1 1"]),
    ("mit", "license", ["(mit|expat|x11) license"], ["mit license"]),
    ("mit-0", "attribution", ["mit no attribution license?"], ["mit 0"]),
    ("bsd-2-clause", "bsd", ["(simplified|freebsd) bsd license", "bsd (2|two) clause license?",
                             "(2|two) clause bsd license?"], ["bsd 2 clause"]),
    ("bsd-3-clause", "bsd", ["(new|modified|revised) bsd license", "bsd (3|three) clause license?",
                             "(3|three) clause bsd license?"], ["bsd 3 clause"]),
    ("bsd-4-clause", "bsd", ["(original|old) bsd license", "bsd (4|four) clause license?"], ["bsd 4 clause"]),
    ("0bsd", "bsd", ["(zero|0) clause bsd license?", "bsd zero clause license?"], ["0bsd"]),
    ("bsd", "bsd", ["bsd style? license"], ["bsd licensed"]),
    ("gpl-2.0", "general", ["gnu? general public license version? v?2 0?"], ["gpl v?2 0?", "gplv2"]),
    ("gpl-3.0", "general", ["gnu? general public license version? v?3 0?"], ["gpl v?3 0?", "gplv3"]),
    ("gpl", "general", ["gnu general public license"], ["gnu gpl"]),
    ("lgpl-2.1", "lesser", ["gnu? (lesser|library) general public license version? v?2 1?"], ["lgpl v?2 1?"]),
    ("lgpl-3.0", "lesser", ["gnu? lesser general public license version? v?3 0?"], ["lgpl v?3 0?"]),
    ("lgpl", "lesser", ["gnu? (lesser|library) general public license"], ["gnu lgpl"]),
    ("agpl-3.0", "affero", ["gnu? affero general public license version? v?3 0?"], ["agpl v?3 0?"]),
    ("agpl", "affero", ["gnu? affero general public license"], ["gnu agpl"]),
    ("gfdl", "documentation", ["gnu? free documentation license"], ["gfdl 1 (2|3)"]),
    ("mpl-2.0", "mozilla", ["mozilla public license version? v?2 0?"], ["mpl v?2 0?"]),
    ("mpl-1.1", "mozilla", ["mozilla public license version? v?1 1"], ["mpl 1 1"]),
    ("mpl", "mozilla", ["mozilla public license"], ["mozilla license"]),
    ("epl-2.0", "eclipse", ["eclipse public license version? v?2 0?"], ["epl 2 0"]),
    ("epl-1.0", "eclipse", ["eclipse public license version? v?1 0?"], ["epl 1 0"]),
    ("cddl-1.0", "distribution", ["common development and distribution license version? (1 0)?"], ["cddl 1 0"]),
    ("cpl-1.0", "common", ["common public license version? (1 0)?"], ["cpl 1 0"]),
    ("eupl-1.2", "european", ["european union public licen[cs]e version? (1 2)?"], ["eupl 1 2"]),
    ("isc", "isc", ["isc license"], ["isc licensed"]),
    ("zlib", "zlib", ["zlib license", "zlib libpng license"], ["zlib licensed"]),
    ("unlicense", "unlicense", ["the unlicense"], ["unlicense license?"]),
    ("wtfpl", "wtfpl", ["do what the f.* you want to public license", "wtfpl license"], ["wtfpl"]),
    ("artistic-2.0", "artistic", ["artistic license version? (2 0)"], ["artistic 2 0"]),
    ("artistic-1.0", "artistic", ["artistic license version? (1 0)?"], ["artistic 1 0"]),
    ("bsl-1.0", "boost", ["boost software license version? (1 0)?"], ["boost 1 0"]),
    ("ofl-1.1", "font", ["sil? open font license version? (1 1)?"], ["ofl 1 1"]),
    ("psf-2.0", "python", ["python software foundation license version? 2?"], ["psf license"]),
    ("postgresql", "postgresql", ["postgresql license"], ["postgresql licensed"]),
    ("openssl", "openssl", ["openssl license"], ["openssl licensed"]),
    ("ncsa", "ncsa", ["university of illinois ncsa open source license", "ncsa license"], ["ncsa"]),
    ("cc0-1.0", "cc0", ["cc0 universal? (1 0)? universal? public? domain? dedication?"], ["cc0 1 0"]),
    ("cc-by-nc-nd", "nd", ["creative commons attribution (noncommercial|non commercial) (noderivatives|no derivatives|noderivs)", "cc by nc nd (\\d 0)?"],
     ["by nc nd"]),
    ("cc-by-nc-sa", "cc", ["cc by nc sa (\\d 0)?"], ["cc by nc sa \\d \\d"]),
    ("cc-by-nc", "cc", ["cc by nc (\\d 0)?"], ["cc by nc \\d \\d"]),
    ("cc-by-nd", "cc", ["cc by nd (\\d 0)?"], ["cc by nd \\d \\d"]),
    ("cc-by-sa", "cc", ["cc by sa (\\d 0)?"], ["cc by sa \\d \\d"]),
    ("cc-by", "cc", ["cc by (\\d 0)?"], ["cc by \\d \\d"]),
    ("cc-by-sa", "creative", ["creative commons attribution (sharealike|share alike)"], ["creative commons (sharealike|share alike)"]),
    ("cc-by-nc", "creative", ["creative commons attribution (noncommercial|non commercial)"], ["creative commons noncommercial"]),
    ("cc-by", "creative", ["creative commons attribution (\\d 0)? international? license?"], ["creative commons by"]),
    ("creative-commons", "creative", ["creative commons license", "creative commons"], ["creativecommons org"]),
    ("odbl-1.0", "database", ["open database license version? (1 0)?"], ["odbl 1 0"]),
    ("cecill-2.1", "cecill", ["cecill free? software? license agreement? (2 1)?"], ["cecill"]),
    ("ms-pl", "microsoft", ["microsoft public license"], ["ms pl"]),
    ("ms-rl", "microsoft", ["microsoft reciprocal license"], ["ms rl"]),
]

#: (priority, confidence, how a name is framed); N takes each name, S each short name
FRAMES = [
    (3, 1.0, "spdx license identifier S"),
    (3, 0.95, "(licensed|released|distributed|published|available|provided) under (the|a|an)? (terms of the)? N"),
    (3, 0.95, "(subject|according) to (the|a)? (terms of the)? N"),
    (2, 0.9, "N"),
    (2, 0.8, "(license|licence|licensed) (under|is)? (the)? S"),
    (1, 0.7, "S licensed?"),
]

#: (label, preferred anchor, priority, confidence, pattern): notices that name no license
NOTICES = [
    ("reserved", "reserved", 1, 0.9, "all rights reserved"),
    ("reserved", "reserved", 1, 0.8, "(some|no) rights reserved"),
    ("cc-by", "cc", 1, 0.7, "cc by"),
    ("gpl", "general", 1, 0.8, "general public license"),
    ("copyright", "copyright", 0, 0.5, "copyright (c|©)? \\d{4}"),
    ("copyright", "copyright", 0, 0.4, "(copyrighted|copyright) (by|material|holder|holders|owner|notice)"),
    ("public-domain", "domain", 2, 0.8, "(released|placed|dedicated) (to|into|in) the public domain"),
    ("public-domain", "domain", 0, 0.4, "public domain"),
    ("permissive-text", "permission", 2, 0.85, "permission is hereby granted free of charge to any person"),
    ("permissive-text", "permission", 2, 0.85,
     "permission to use copy modify and or? distribute this software for any purpose"),
    ("permissive-text", "redistribution", 2, 0.85, "redistribution and use in source and binary forms"),
    ("no-warranty", "warranty", 0, 0.4, "without (any)? warranty"),
    ("no-warranty", "warranties", 0, 0.4, "as is without warranties"),
    ("proprietary", "proprietary", 1, 0.6, "proprietary and confidential"),
    ("proprietary", "permission", 1, 0.6, "may not be (reproduced|copied|distributed|republished) without .* permission"),
    ("unspecified-license", "license", 0, 0.3, "licensed under (the|a|an)"),
    ("unspecified-license", "licence", 0, 0.3, "licenced under"),
]


def _tokens(pattern: str) -> list[tuple[str, bool]]:
    """(token, optional) of a pattern over words."""
    out = []
    for token in re.findall(r"\([^)]*\)\??|\S+", pattern):
        optional = token.endswith("?") and (token.startswith("(") or "?" not in token[:-1]) and len(token) > 1
        out.append((token[:-1] if optional else token, optional))
    return out


def anchors_of(pattern: str, wish: str) -> list[str]:
    """Words of which every match of the pattern holds at least one: one word of
    each alternative of a required token (the one with ``wish``, if there is any)."""
    choices = []
    for core, optional in _tokens(pattern):
        alts = [alt.split() for alt in core[1:-1].split("|")] if core.startswith("(") else [[core]]
        plain = [[w for w in alt if re.fullmatch(r"\w+", w)] for alt in alts]
        if not optional and all(plain):
            words = sorted({wish if wish in alt else max(alt, key=len) for alt in plain})
            choices.append((wish not in words, len(words), -min(map(len, words)), words))
    return min(choices)[-1]


def words_regex(pattern: str) -> str:
    """Pattern over words -> regular expression over ' w1  w2 ... ' (a blank on
    both sides of every word). ``x?`` and ``(a b)?`` are optional, ``.*`` is any
    one word; the expression runs the same in Java and in RE2."""
    out = []
    for core, optional in _tokens(pattern):
        if core.startswith("("):
            alts = ["".join(f" {w} " for w in alt.split()) for alt in core[1:-1].split("|")]
            one = "(?:" + "|".join(alts) + ")"
        else:
            one = f" {core.replace('.*', '[^ ]+')} "
        out.append(f"(?:{one})?" if optional else one)
    return "".join(out)


def rules() -> list[dict]:
    """All rules, in order: one per family, frame and name, then the notices; a rule
    with several anchors is listed under each. A name is found by its family's anchor
    word where it requires it, a short name by its first word."""
    out = []

    def add(text: str, wish: str, **rule) -> None:
        out.extend({"pattern": words_regex(text), "anchor": f" {a} ", **rule} for a in anchors_of(text, wish))

    for label, anchor, names, shorts in FAMILIES:
        for priority, confidence, frame in FRAMES:
            short = "S" in frame.split()
            for name in (shorts if short else names):
                text = " ".join(name if w in ("N", "S") else w for w in frame.split())
                lead = re.split(r"[ ?]", name)[0] if short else anchor
                add(text, lead, label=label, priority=priority, confidence=confidence)
    for label, anchor, priority, confidence, text in NOTICES:
        add(text, anchor, label=label, priority=priority, confidence=confidence)
    return out


#: the anchor words of all rules; a text without any is done
STEMS = sorted({r["anchor"].strip() for r in rules()})


def normalised(text: Column) -> Column:
    """' w1  w2 ... ' of a text; empty without words."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    bare = F.trim(F.regexp_replace(F.translate(F.coalesce(text, F.lit("")), upper, lower), NOT_WORD, "  "))
    return F.when(bare == "", F.lit("")).otherwise(F.concat(F.lit(" "), bare, F.lit(" ")))


def _places(norm: Column, pattern: Column, wrap) -> Column:
    """All places of a pattern as an array of ``wrap(start, end)`` (words from
    0, end exclusive). Marks are set around the matches, the text is split into
    words, and the words before a mark are its index less the marks before."""
    marked = F.regexp_replace(norm, pattern, F.lit(" \u0001 $0 \u0002 "))
    tokens = F.split(F.trim(marked), " +")

    def where(t: Column, mark: str) -> Column:
        return F.filter(F.transform(t, lambda w, i: F.when(w == mark, i)), lambda i: i.isNotNull())

    return F.flatten(F.transform(
        F.transform(F.array(tokens), lambda t: F.struct(where(t, "\u0001").alias("a"), where(t, "\u0002").alias("b"))),
        lambda m: F.transform(m["a"], lambda s, n: wrap(s - 2 * n, F.get(m["b"], n) - 2 * n - 1))))


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_words long, n_base long, first_word long, last_word long,
    base_labels string, labels string, score double, spans): one row per row.
    ``spans`` holds the detections left after suppression (start word, end word,
    label, priority, confidence)."""
    table = rules()
    anchors = [f" {w} " for w in STEMS]
    # a literal, folded once when the query is planned
    by_anchor = F.from_json(
        F.lit(json.dumps({a: [r for r in table if r["anchor"] == a] for a in anchors})),
        "map<string,array<struct<pattern:string,label:string,priority:int,confidence:double>>>")
    span = "struct<s:int,ne:int,np:int,label:string,confidence:double>"
    none = F.array().cast(f"array<{span}>")

    # the one-element explode keeps a costly value from being computed again
    # inside every expression that uses it
    gated = docs.select(key, F.explode(F.array(normalised(F.col(text)))).alias("norm"))
    n_words = F.when(F.col("norm") == "", F.lit(0)).otherwise(
        (F.octet_length("norm") - F.octet_length(F.replace("norm", F.lit("  "), F.lit("")))) / 2 + 1).cast("long")
    found = gated.select(key, n_words.alias("n_words"), "norm", F.when(F.col("norm") != "", F.filter(
        F.array(*[F.when(F.contains("norm", F.lit(a)), F.lit(a)) for a in anchors]),
        lambda a: a.isNotNull())).otherwise(F.array().cast("array<string>")).alias("kws"))
    norm = F.col("norm")

    def of_rule(r: Column) -> Column:
        return _places(norm, r["pattern"], lambda s, e: F.struct(
            s.alias("s"), (-e).alias("ne"), (-r["priority"]).alias("np"), r["label"].alias("label"),
            r["confidence"].alias("confidence")).cast(span))

    dets = F.flatten(F.transform(
        F.filter(F.flatten(F.transform(F.col("kws"), lambda k: F.element_at(by_anchor, k))),
                 lambda r: F.regexp_like(norm, r["pattern"])), of_rule))
    starts = F.array_sort(F.flatten(F.array(*[
        F.when(F.contains(norm, F.lit(words_regex(p))), _places(norm, F.lit(words_regex(p)), lambda s, e: s))
        .otherwise(F.array().cast("array<int>")) for p in BASE])))
    base_labels = F.array_sort(F.filter(F.array(*[
        F.when(F.contains(norm, F.lit(words_regex(p))), F.lit(b)) for p, b in BASE.items()]),
        lambda x: x.isNotNull()))
    # the marks of a place in front of a text without any anchor never arise
    hit = F.size("kws") > 0
    step1 = found.select(
        key, "n_words",
        F.explode(F.array(F.struct(F.when(hit, dets).otherwise(none).alias("dets"),
                                   F.when(hit, starts).otherwise(F.array().cast("array<int>")).alias("starts"),
                                   F.when(hit, base_labels).otherwise(F.array().cast("array<string>")).alias("base"),
                                   ))).alias("x"))
    # the fold keeps four running maxima and a mark a place, in pieces of FOLD marks, so
    # that no value grows with every step
    zero = F.struct(F.lit("").alias("done"), F.lit("").alias("now"), *[F.lit(-1).alias(f"m{p}") for p in range(4)])

    def visit(acc: Column, d: Column) -> Column:
        end, p = -d["ne"], -d["np"]
        reach = F.greatest(*[F.when(F.lit(t) >= p, acc[f"m{t}"]).otherwise(F.lit(-1)) for t in range(4)])
        full = F.octet_length(acc["now"]) >= FOLD
        mark = F.when(reach >= end, F.lit("0")).otherwise(F.lit("1"))
        return F.struct(
            F.when(full, F.concat(acc["done"], acc["now"])).otherwise(acc["done"]).alias("done"),
            F.when(full, mark).otherwise(F.concat(acc["now"], mark)).alias("now"),
            *[F.when(p == t, F.greatest(acc[f"m{t}"], end)).otherwise(acc[f"m{t}"]).alias(f"m{t}")
              for t in range(4)])

    marked = step1.select(key, "n_words", "x", F.explode(F.array(F.array_sort("x.dets"))).alias("dets"))
    marks = F.split(F.aggregate("dets", zero, visit, lambda acc: F.concat(acc["done"], acc["now"])), "")
    kept = F.when(F.size("dets") == 0, none).otherwise(F.transform(F.filter(
        F.zip_with("dets", marks, lambda d, m: F.struct(d.alias("d"), m.alias("m"))), lambda x: x["m"] == "1"), lambda x: x["d"]))
    step2 = marked.select(key, "n_words", "x", F.explode(F.array(kept)).alias("kept"))
    return step2.select(
        key, "n_words", F.size("x.starts").cast("long").alias("n_base"),
        F.get("x.starts", F.lit(0)).cast("long").alias("first_word"),
        F.when(F.size("x.starts") > 0, F.element_at("x.starts", -1)).cast("long").alias("last_word"),
        F.array_join("x.base", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(F.col("x.base"), F.transform("kept", lambda d: d["label"]))), ",")
        .alias("labels"),
        F.coalesce(F.array_max(F.transform("kept", lambda d: d["confidence"])), F.lit(0.0)).alias("score"),
        F.transform("kept", lambda d: F.struct(
            d["s"].alias("start"), (-d["ne"]).alias("end"), d["label"].alias("label"),
            (-d["np"]).alias("priority"), d["confidence"].alias("confidence"))).alias("spans"))
