"""License scans by ordered signature rules.

A text becomes its words, lower-cased and one blank apart. Each rule is a regular
expression over words, looked for only in a text that has the rule's keyword, and
there in the words about each place of it.
Rules are ordered: grants and identifiers before names with a version before
bare names before hints. A detection inside another one of the same or an earlier tier is
suppressed; of equal ones the earlier rule's stays. Only DataFrame functions are
used: the rules are an array, which each text filters by keyword.
"""

from __future__ import annotations

import json
import operator
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import tables

# Phrases that are always detected, with their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Names of licenses as written in words, by label: a keyword, which each of its texts has once, the name, the versions.
NAMES = [
    ("apache", " apache", r"apache(?: software)?(?: licen[cs]e)?", ["1 0", "1 1", "2 0"]),
    ("mit", " mit licen", r"mit(?: licen[cs]e)", []),
    ("mit-x11", " x11 licen", r"(?:mit )?x11 licen[cs]e", []),
    ("expat", " expat licen", r"expat licen[cs]e", []),
    ("bsd-2-clause", "bsd", r"(?:bsd 2 clause|2 clause bsd|simplified bsd|freebsd)(?: licen[cs]e)?", []),
    ("bsd-3-clause", " bsd", r"(?:bsd 3 clause|3 clause bsd|new bsd|modified bsd|revised bsd)(?: licen[cs]e)?", []),
    ("bsd-4-clause", " bsd", r"(?:bsd 4 clause|4 clause bsd|original bsd|old bsd)(?: licen[cs]e)?", []),
    ("bsd-0-clause", "bsd", r"(?:0bsd|bsd 0 clause|zero clause bsd|bsd zero clause)(?: licen[cs]e)?", []),
    ("bsd", " bsd", r"bsd(?: style)? licen[cs]e", []),
    ("isc", " isc licen", r"isc licen[cs]e", []),
    ("zlib", " zlib", r"zlib(?: libpng)? licen[cs]e", []),
    ("libpng", " libpng licen", r"libpng licen[cs]e", ["1 6 35", "2 0"]),
    ("boost", " boost", r"boost(?: software)? licen[cs]e", ["1 0"]),
    ("bsl", " bsl", r"bsl", ["1 0", "1 1"]),
    ("agpl", " affero general", r"(?:gnu )?affero general public licen[cs]e", ["1 0", "3 0", "3"]),
    ("agpl", " agpl", r"(?:gnu )?agpl", ["1 0", "3 0", "3"]),
    ("agpl", " agplv3", r"agplv3", []),
    ("lgpl", " lesser general", r"(?:gnu )?lesser general public licen[cs]e", ["2 1", "3 0", "3"]),
    ("lgpl", " library general", r"(?:gnu )?library general public licen[cs]e", ["2 0", "2"]),
    ("lgpl", " lgpl", r"(?:gnu )?lgpl", ["2 0", "2 1", "3 0", "2", "3"]),
    ("gpl", " general public licen", r"(?:gnu )?general public licen[cs]e", ["1 0", "2 0", "3 0", "1", "2", "3"]),
    ("gpl", " gpl", r"(?:gnu )?gpl", ["1 0", "2 0", "3 0", "1", "2", "3"]),
    ("gpl-2.0", " gplv2", r"(?:gnu )?gplv2", []),
    ("gpl-3.0", " gplv3", r"(?:gnu )?gplv3", []),
    ("gfdl", " free documentation", r"(?:gnu )?free documentation licen[cs]e", ["1 1", "1 2", "1 3"]),
    ("mpl", " mozilla", r"mozilla public licen[cs]e", ["1 0", "1 1", "2 0"]),
    ("mpl", " mpl", r"mpl", ["1 0", "1 1", "2 0"]),
    ("epl", " eclipse", r"eclipse public licen[cs]e", ["1 0", "2 0"]),
    ("epl", " epl", r"epl", ["1 0", "2 0"]),
    ("edl", " eclipse", r"eclipse distribution licen[cs]e", ["1 0"]),
    ("cddl", " development and distribution", r"common development and distribution licen[cs]e", ["1 0", "1 1"]),
    ("cddl", " cddl", r"cddl", ["1 0", "1 1"]),
    ("cpl", " common public", r"common public licen[cs]e", ["1 0"]),
    ("eupl", " eupl", r"eupl", ["1 0", "1 1", "1 2"]),
    ("eupl", " european union", r"european union public licen[cs]e", ["1 0", "1 1", "1 2"]),
    ("artistic", " artistic", r"artistic licen[cs]e", ["1 0", "2 0"]),
    ("perl", " as perl", r"same (?:terms|licen[cs]e) as perl(?: itself)?", []),
    ("python", " python", r"python(?: software foundation)? licen[cs]e", ["2 0"]),
    ("psf", " psf", r"psf licen[cs]e", ["2 0"]),
    ("ruby", " ruby licen", r"ruby licen[cs]e", []),
    ("php", " php licen", r"php licen[cs]e", ["3 0", "3 01"]),
    ("openssl", " openssl", r"openssl licen[cs]e", []),
    ("sspl", " server side public", r"server side public licen[cs]e", ["1"]),
    ("sspl", " sspl", r"sspl", ["1 0", "1"]),
    ("elastic", " elastic licen", r"elastic licen[cs]e", ["2 0"]),
    ("busl", " business source", r"business source licen[cs]e", ["1 1"]),
    ("ms-pl", " microsoft", r"microsoft public licen[cs]e", []),
    ("ms-rl", " microsoft", r"microsoft reciprocal licen[cs]e", []),
    ("apple-psl", " apple public", r"apple public source licen[cs]e", ["1 0", "1 1", "1 2", "2 0"]),
    ("ofl", " open font", r"(?:sil )?open font licen[cs]e", ["1 0", "1 1"]),
    ("osl", " open software licen", r"open software licen[cs]e", ["1 0", "1 1", "2 0", "2 1", "3 0"]),
    ("afl", " academic free", r"academic free licen[cs]e", ["1 1", "1 2", "2 0", "2 1", "3 0"]),
    ("odbl", " database licen", r"open (?:data commons open )?database licen[cs]e", ["1 0"]),
    ("odc-by", " data commons attribution", r"open data commons attribution licen[cs]e", ["1 0"]),
    ("pddl", " domain dedication", r"public domain dedication and licen[cs]e", ["1 0"]),
    ("wtfpl", " wtfpl", r"wtfpl", ["1", "2"]),
    ("unlicense", " unlicense", r"(?:the )?unlicense", []),
    ("postgresql", " postgresql", r"postgresql licen[cs]e", []),
    ("curl", " curl licen", r"curl licen[cs]e", []),
    ("vim", " vim licen", r"vim licen[cs]e", []),
    ("ecl", " educational community", r"educational community licen[cs]e", ["1 0", "2 0"]),
    ("ncsa", " ncsa", r"(?:university of illinois )?ncsa(?: open source)? licen[cs]e", []),
    ("upl", " universal permissive", r"universal permissive licen[cs]e", ["1 0"]),
    ("cc0", " cc0", r"(?:creative commons )?cc0", ["1 0"]),
    ("cc-by-nc-nd", " cc by nc nd", r"cc by nc nd", ["1 0", "2 0", "2 5", "3 0", "4 0"]),
    ("cc-by-nc-sa", " cc by nc sa", r"cc by nc sa", ["1 0", "2 0", "2 5", "3 0", "4 0"]),
    ("cc-by-nc", " cc by nc", r"cc by nc", ["1 0", "2 0", "2 5", "3 0", "4 0"]),
    ("cc-by-sa", " cc by sa", r"cc by sa", ["1 0", "2 0", "2 5", "3 0", "4 0"]),
    ("cc-by-nd", " cc by nd", r"cc by nd", ["1 0", "2 0", "2 5", "3 0", "4 0"]),
    ("cc-by", " cc by", r"cc by", ["1 0", "2 0", "2 5", "3 0", "4 0"]),
    ("cc-by-nc-nd", " commons attribution", r"creative commons attribution non ?commercial no ?deriv(?:ative)?s?", ["2 0", "2 5", "3 0", "4 0"]),
    ("cc-by-sa", " commons attribution", r"creative commons attribution share ?alike", ["2 0", "2 5", "3 0", "4 0"]),
    ("cc-by-nc", " commons attribution", r"creative commons attribution non ?commercial", ["2 0", "2 5", "3 0", "4 0"]),
    ("cc-by", " commons attribution", r"creative commons attribution", ["2 0", "2 5", "3 0", "4 0"]),
]
#: Sentences that grant or withhold without a license's name.
SENTENCES = [
    ("mit", " permission", r"permission is hereby granted free of charge to any person obtaining a copy"),
    ("isc", " permission", r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("bsd", " redistribution and use", r"redistribution and use in source and binary forms with or without modification are permitted"),
    ("unlicense", " unencumbered", r"this is free and unencumbered software released into the public domain"),
    ("zlib", " arising from", r"in no event will the authors be held liable for any damages arising from the use of this software"),
    ("boost", " obtaining a copy", r"obtaining a copy of the software and accompanying documentation covered by this licen[cs]e"),
    ("gpl", " can redistribute", r"you can redistribute it and or modify it under the terms of the gnu general public licen[cs]e"),
    ("lgpl", " can redistribute", r"you can redistribute it and or modify it under the terms of the gnu lesser general public licen[cs]e"),
    ("proprietary", " confidential", r"(?:proprietary and confidential|confidential and proprietary)"),
    ("proprietary", " unauthorized", r"unauthorized (?:copying|use|reproduction|distribution) of this (?:file|document|work|software)"),
    ("proprietary", " may not be", r"may not be (?:reproduced|copied|distributed)(?: or (?:reproduced|copied|distributed))? without (?:the )?(?:prior )?(?:written )?permission"),
]
HINTS = [
    ("public-domain", " the public domain", r"(?:in|into|to) the public domain"),
    ("all-rights-reserved", " rights reserved", r"(?:all|some|no) rights reserved"),
    ("copyright", " copyright", r"copyright(?: c)? (?:19|20)[0-9]{2}"),
    ("unknown-license", " licen", r"licen[cs]ed under"),
    ("unknown-license", " licen", r"licen[cs]e agreement"),
]
GRANT = r"(?:(?:re)?licen[cs]ed|released|(?:re)?distributed|available|published|provided|covered|shared|made available) (?:only )?under (?:the )?(?:terms (?:and conditions )?of )?(?:the )?"
#: By tier: how sure a detection is.
SURE = (0.99, 0.9, 0.7, 0.3)
SURE_PHRASE = 0.5


@dataclass(frozen=True)
class Rule:
    label: str
    keyword: str
    pattern: str
    tier: int


def rules() -> list[Rule]:
    """All signature rules in their order: grants and SPDX identifiers, names with a version, bare names, hints."""
    out = [Rule(label, k, p, 0) for label, k, p in SENTENCES]
    for label, keyword, name, versions in NAMES:
        for v in versions:
            both = f"{label}-{v.replace(' ', '.') if ' ' in v else v + '.0'}", keyword
            version = rf"{name}(?: licen[cs]e)?(?: v| ver| version)? {v}(?: or(?: at your option)?(?: any)? later)?"
            out.append(Rule(*both, GRANT + version, 0))
            out.append(Rule(*both, GRANT + rf"version {v} of the {name}", 0))
            out.append(Rule(*both, version, 1))
        out.append(Rule(label, keyword, GRANT + name, 0))
        out.append(Rule(label, keyword, rf"spdx licen[cs]e identifier {name}", 0))
        out.append(Rule(label, keyword, name, 2))
    out += [Rule(label, k, p, 3) for label, k, p in HINTS]
    return sorted(out, key=lambda r: r.tier)  # stable


def normal(text: Column) -> Column:
    """The words of a text, each between single blanks; letters A to Z in lower case, null as empty."""
    low = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.concat(F.lit(" "), F.ltrim(F.concat(F.rtrim(F.regexp_replace(low, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " ")), F.lit(" "))))


def blanks(x: Column) -> Column:
    return F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit("")))


#: Array elements that are gone through one by one, each copying those before.
CHUNK = 100


def running(x: Column, join: Callable[[Column, Column], Column], depth: int = 2) -> Column:
    """What `join` (addition, or the greater one) makes of the numbers before each place of an array, from 0 on; longer arrays go by chunks, and chunks of chunks."""

    def total(c: Column) -> Column:
        return F.aggregate(c, F.lit(0), lambda acc, v: join(acc, v))

    def plain(c: Column) -> Column:
        zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(c, zero, lambda acc, v: F.struct(join(acc["at"], v).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")))["out"]

    def by_chunks(chunks: Column) -> Column:
        heads = running(F.transform(chunks, total), join, depth - 1)
        return F.flatten(F.zip_with(chunks, heads, lambda c, head: F.transform(plain(c), lambda v: join(v, head))))

    if depth == 0:
        return plain(x)

    def cut(x: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(x) - 1) / CHUNK).cast("int")), lambda i: F.slice(x, i * CHUNK + 1, F.lit(CHUNK)))

    return tables.let(x, lambda x: F.when(F.size(x) <= CHUNK, plain(x)).otherwise(tables.let(cut(x), by_chunks)))


def _matches(text: Column, pattern: str) -> Column:
    """The matches of a pattern in a normal text as an array of (start, end): words from 0, the end exclusive."""
    found = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), blanks)
    gaps = F.transform(F.split(text, pattern, -1), blanks)

    def placed(both: Column) -> Column:
        before = running(F.transform(both, lambda x: x["gap"] + x["inner"]), operator.add)
        return F.zip_with(both, before, lambda x, at: F.struct((at + x["gap"] - 1).alias("start"), (at + x["gap"] + x["inner"]).alias("end")))

    return tables.let(tables.let(found, lambda f: F.zip_with(f, F.slice(gaps, 1, F.size(f)), lambda m, g: F.struct(g.alias("gap"), m.alias("inner")))), placed)


#: Words on either side of a keyword that a rule may take in at most.
AROUND = 30


def _windows(text: Column, keyword: Column) -> Column:
    """(before, x) for each place of a keyword: up to AROUND words on either side, though not beyond the next place, and the blanks of the text before them."""

    def of(pieces: Column) -> Column:
        def by_place(before: Column) -> Column:
            def one(i: Column) -> Column:
                left = F.element_at(pieces, i)
                near, far = F.substring_index(left, " ", -AROUND), F.substring_index(F.element_at(pieces, i + 1), " ", AROUND)
                return F.struct((F.element_at(before, i) + blanks(left) - blanks(near)).alias("before"), F.concat(F.lit(" "), near, keyword, far, F.lit(" ")).alias("x"))

            return F.transform(F.sequence(F.lit(1), F.size(pieces) - 1), one)

        return tables.let(running(F.transform(pieces, lambda p: blanks(p) + blanks(keyword)), operator.add), by_place)

    return tables.let(F.split(text, keyword, F.lit(-1)), of)


def whole_words(pattern: str) -> str:
    return f"(?<= )(?:{pattern})(?= )"


PHRASE = whole_words("|".join(PHRASES))


def scan(docs: DataFrame, ordered: list[Rule] | None = None) -> DataFrame:
    """`docs` with n_words, places (of the fixed phrases: start, end), phrase_labels and detections (start, end, rank, tier, label); earlier columns of these names are replaced.

    Null and empty texts have none. Rows are scanned one by one, so ids, repeats and other columns don't matter. Detections are
    by start; those that others suppress are left out. Work grows with a text's length and the rules whose keyword it has.
    """
    ordered = rules() if ordered is None else ordered
    told = [{"keyword": k, "rules": [{"rank": i, "tier": r.tier, "label": r.label, "pattern": whole_words(r.pattern)} for i, r in enumerate(ordered) if r.keyword == k]} for k in sorted({r.keyword for r in ordered})]
    listed = F.from_json(F.lit(json.dumps(told)), "array<struct<keyword:string,rules:array<struct<rank:int,tier:int,label:string,pattern:string>>>>")  # a constant

    def detected(text: Column) -> Column:
        def by_rule(w: Column, r: Column) -> Column:
            parts = F.split(w["x"], r["pattern"], F.lit(2))  # a window has one place of the keyword, so one match at most
            first = w["before"] + blanks(F.element_at(parts, 1)) - 2
            inner = blanks(F.regexp_substr(w["x"], r["pattern"]))
            return F.struct(first.alias("start"), (-first - inner - 1).alias("back"), r["rank"].alias("rank"), r["tier"].alias("tier"), r["label"].alias("label"))

        def by_keyword(g: Column) -> Column:
            def by_window(w: Column) -> Column:
                return F.transform(F.filter(g["rules"], lambda r: F.rlike(w["x"], r["pattern"])), lambda r: by_rule(w, r))

            return F.flatten(F.transform(_windows(text, g["keyword"]), by_window))

        return F.array_sort(F.flatten(F.transform(F.filter(listed, lambda g: F.contains(text, g["keyword"])), by_keyword)))

    def kept(spans: Column) -> Column:
        def ends_of(t: int) -> Column:
            return F.transform(spans, lambda s: F.when(s["tier"] <= t, -s["back"]).otherwise(F.lit(0)))

        reach = [running(ends_of(t), F.greatest) for t in range(len(SURE))]  # by tier, how far earlier ones of that tier or one before go
        ends = F.arrays_zip(spans.alias("s"), *[x.alias(f"t{t}") for t, x in enumerate(reach)])

        def far(x: Column) -> Column:
            out = x[f"t{len(SURE) - 1}"]
            for t in range(len(SURE) - 1):
                out = F.when(x["s"]["tier"] == t, x[f"t{t}"]).otherwise(out)
            return out

        whole = F.filter(ends, lambda x: far(x) < -x["s"]["back"])
        return F.transform(whole, lambda x: F.struct(x["s"]["start"].alias("start"), (-x["s"]["back"]).alias("end"), x["s"]["rank"].alias("rank"), x["s"]["tier"].alias("tier"), x["s"]["label"].alias("label")))

    none = F.array().cast("array<struct<start:int,end:int,rank:int,tier:int,label:string>>")

    def scanned(text: Column) -> Column:
        said = F.contains(text, F.lit(" cc by ")) | F.contains(text, F.lit(" general public license ")) | F.contains(text, F.lit(" all rights reserved "))
        places = F.when(said, _matches(text, PHRASE)).otherwise(F.array().cast("array<struct<start:int,end:int>>"))
        labels = F.filter(F.array(*[F.when(F.contains(text, F.lit(f" {p} ")), F.lit(x)) for p, x in PHRASES.items()]), lambda x: x.isNotNull())
        spans = tables.let(detected(text), lambda s: F.when(F.size(s) == 0, none).otherwise(kept(s)))
        return F.struct((blanks(text) - 1).cast("long").alias("n_words"), places.alias("places"), labels.alias("phrase_labels"), spans.alias("detections"))

    names = ("n_words", "places", "phrase_labels", "detections")
    found = tables.fresh(docs, "found")
    docs = docs.drop(*names).withColumn(found, tables.let(normal(F.col("text")), scanned))
    return docs.withColumns({c: F.col(f"`{found}`.{c}") for c in names}).drop(found)


def score(phrases: Column, detections: Column) -> Column:
    """How sure the surest detection is; 0 without any."""
    weights = F.array(*[F.lit(w) for w in SURE])
    best = F.array_max(F.transform(detections, lambda d: F.element_at(weights, d["tier"] + 1)))
    return F.greatest(F.coalesce(best, F.lit(0.0)), F.when(F.size(phrases) > 0, F.lit(SURE_PHRASE)).otherwise(F.lit(0.0)))


def op11_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a document, repeated ones too: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score; a null text reads as empty."""
    out = scan(tables.read(spark, sf_dir, "documents").select("doc_id", "text"))
    starts = F.transform("places", lambda m: m["start"].cast("long"))
    labels = F.array_distinct(F.concat("phrase_labels", F.transform("detections", lambda d: d["label"])))
    return out.select(
        "doc_id",
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        F.array_join(F.array_sort("phrase_labels"), ",").alias("base_labels"),
        F.array_join(F.array_sort(labels), ",").alias("labels"),
        score(F.col("phrase_labels"), F.col("detections")).alias("score"),
    )
