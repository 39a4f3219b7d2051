"""License scan by ordered signature rules, in SQL expressions alone.

A text is lower-cased (A-Z) and cut into words of letters, digits and characters
beyond ASCII. A rule is a regular expression over the words joined by single
spaces, with a label, a priority and a keyword. Texts without any of ``GATES`` are
not cut at all, and a rule runs only where its keyword occurs, so most texts cost
one scan. Detections are word intervals. Of these, one
that lies inside another of the same or a higher priority is suppressed; what is
left is the method's labels. Long texts are scanned by windows of ``CORE`` words that overlap by more than two rules are
long, so that the work follows the text.

Rules come from ``FAMILIES`` (a name, its keywords, its versions) and
``FORMS`` (tag, grant, versioned name, bare name), in that order of priority.

Everything happens inside a row: no shuffle, no grouping, so repeated rows, null
ids and one frequent source need no care. Null texts count as empty: no words, no
labels, score 0.
"""

from __future__ import annotations

from itertools import product

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Base phrases and their labels.
BASE = {
    "cc by": "cc-by",
    "general public license": "gpl",
    "all rights reserved": "reserved",
}

#: label, names as word regexes, keywords, versions (as words; the first of equal forms counts).
FAMILIES = (
    ("apache", "apache(?: software)?(?: license)?", ("apache",), ("1 0", "1 1", "2 0")),
    ("mit", "(?:mit|expat|x11)(?: license)?", ("mit", "expat", "x11"), ()),
    ("bsd", "(?:bsd(?: license)?|berkeley software distribution)", ("bsd", "berkeley"), ("2 clause", "3 clause", "4 clause")),
    ("isc", "isc license", ("isc",), ()),
    ("zlib", "(?:zlib libpng|zlib|libpng)(?: license)?", ("zlib", "libpng"), ()),
    ("boost", "boost software license", ("boost",), ("1 0",)),
    ("gpl", "(?:gnu )?(?:gpl|general public license)", ("gpl", "general"), ("1", "2", "3", "1 0", "2 0", "3 0")),
    ("lgpl", "(?:gnu )?(?:lgpl|(?:lesser|library) general public license)", ("lgpl", "lesser", "library"), ("2", "2 0", "2 1", "3", "3 0")),
    ("agpl", "(?:gnu )?(?:agpl|affero general public license)", ("agpl", "affero"), ("1", "1 0", "3", "3 0")),
    ("gfdl", "(?:gnu )?(?:gfdl|free documentation license)", ("gfdl", "documentation"), ("1 1", "1 2", "1 3")),
    ("mpl", "(?:mpl|mozilla public license)", ("mpl", "mozilla"), ("1 0", "1 1", "2 0")),
    ("epl", "(?:epl|eclipse public license)", ("epl", "eclipse"), ("1 0", "2 0")),
    ("cddl", "(?:cddl|common development and distribution license)", ("cddl", "common"), ("1 0", "1 1")),
    ("cpl", "(?:cpl|common public license)", ("cpl", "common"), ("1 0",)),
    ("eupl", "(?:eupl|european union public licen[cs]e)", ("eupl", "european"), ("1 0", "1 1", "1 2")),
    ("artistic", "artistic license", ("artistic",), ("1 0", "2 0")),
    ("ofl", "(?:ofl|open font license)", ("ofl", "font"), ("1 0", "1 1")),
    ("odbl", "(?:odbl|open (?:data commons open )?database license)", ("odbl", "database"), ("1 0",)),
    ("ms-pl", "(?:ms pl|microsoft public license)", ("ms", "microsoft"), ()),
    ("psf", "(?:psf license|python software foundation license)", ("psf", "python"), ("2",)),
    ("php", "php license", ("php",), ("3 0", "3 01")),
    ("unlicense", "(?:the )?unlicense", ("unlicense",), ()),
    ("wtfpl", "(?:wtfpl|do what the fuck you want to public license)", ("wtfpl", "want"), ("2",)),
    ("cc0", "(?:cc0|cc zero|creative commons zero)", ("cc0", "zero"), ("1 0",)),
    ("public-domain", "(?:in|into|to) the public domain", ("domain",), ()),
)

#: Parts of the names of Creative Commons licenses: short and long words of each, by label.
CC_PARTS = (
    ("cc-by", "by", "attribution"),
    ("cc-by-sa", "by sa", "attribution share ?alike"),
    ("cc-by-nd", "by nd", "attribution no ?deriv(?:ative)?s"),
    ("cc-by-nc", "by nc", "attribution non ?commercial"),
    ("cc-by-nc-sa", "by nc sa", "attribution non ?commercial share ?alike"),
    ("cc-by-nc-nd", "by nc nd", "attribution non ?commercial no ?deriv(?:ative)?s"),
)
CC_VERSIONS = ("1 0", "2 0", "2 5", "3 0", "4 0")

#: A form around a name, its priority, the keyword it adds.
FORMS = (
    ("spdx license identifier {}", 4, "spdx"),
    ("(?:licen[cs]ed|released|distributed|available|published|provided) under (?:(?:the )?terms of )?(?:(?:an?|the) )?{}", 3, "under"),
    ("{}", 2, ""),
)

#: Rules without a family: label, regex, keywords, priority.
SINGLE = (
    ("reserved", "(?:all|some|no) rights reserved", ("reserved",), 2),
    ("copyright", "copyright (?:(?:c|©) ?)?(?:19|20)[0-9]{2}", ("copyright",), 1),
    ("proprietary", "(?:proprietary and confidential|confidential and proprietary)", ("proprietary",), 3),
    ("permissive", "permission is hereby granted free of charge", ("granted",), 3),
    ("bsd", "redistribution and use in source and binary forms", ("redistribution",), 3),
    ("noncommercial", "for non ?commercial (?:use|purposes) only", ("commercial", "noncommercial"), 2),
)

#: Rules run on texts that hold one of these (any case), one of ``SHORT_GATES`` as words, "under" and one of
#: ``UNDER_GATES``, or "cc" and "by" as words in a row. Each rule needs one of them; the tests hold the forms that the rules accept against them.
GATES = (
    "licen", "reserved", "copyright", "spdx", "gpl", "apache", "mozilla", "commons", "cc0", "domain", "granted",
    "redistribution", "proprietary", "commercial", "bsd", "zlib", "cddl", "eupl", "wtfpl",
    "gfdl", "odbl", "libpng", "expat", "x11", "berkeley",
)
SHORT_GATES = ("mpl", "epl", "cpl", "ofl", "ms pl", "cc zero", "cc attribution")
UNDER_GATES = ("mit",)

#: Words whose detections are looked for at once, and words beside them that are looked at too: more than two rules are long.
CORE = 1024
MARGIN = 96

#: Confidence of a detection by priority, and of a base label.
WEIGHTS = {1: 0.5, 2: 0.7, 3: 0.9, 4: 1.0}
BASE_WEIGHT = 0.8

_WORD = r"[0-9A-Za-z\\x{80}-\\x{10FFFF}]+"
_EDGE = r"(?<![0-9a-z\\x{80}-\\x{10FFFF}])"
_GAP = r"[\\x00-/:-`{-\\x7f]+"
_CC_BY = f"{_EDGE}cc{_GAP}by"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def rules() -> list[tuple[str, str, str, int]]:
    """(label, keyword, regex, priority), in order; a family's rule stands once for each of its keywords."""
    out = []
    families = [
        (label, name, keys, versions) for label, name, keys, versions in FAMILIES
    ] + [
        (label, f"(?:cc|creative commons) (?:{short}|{long})", ("cc", "commons"), CC_VERSIONS)
        for label, short, long in CC_PARTS
    ]
    for (form, priority, more), (label, name, keys, versions) in product(FORMS, families):
        for version in (*versions, ""):
            number = f"(?: license)?(?: version)? ?v?{version}(?: or later| only)?" if version else ""
            if not version and priority == 2 and label in ("mit", "zlib", "apache", "bsd"):
                number = " license" if "license" not in name else ""  # a bare short name may be anything
                body = name.replace("(?: license)?", "") + " license"
            else:
                body = name + number
            kept = f"{label}-{version.replace(' ', '.')}" if version else label
            out.append((kept, more or keys[0], keys, form.format(body), priority if version or priority != 2 else 1))
    rows = [(label, key, regex, p) for label, first, keys, regex, p in out for key in ([first] if first != keys[0] else keys)]
    rows += [(label, key, regex, p) for label, regex, keys, p in SINGLE for key in keys]
    return list(dict.fromkeys(rows))


def _as_words(phrases: tuple[str, ...]) -> str:
    """A regex for these, as words of a text in lower case; a version may be glued to the last."""
    return f"{_EDGE}(?:{'|'.join(p.replace(' ', _GAP) for p in phrases)})(?:v?[0-9]+)?{_EDGE.replace('?<!', '?!')}"


def _text(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, detections."""
    text = F.coalesce("text", F.lit(""))
    found = docs.select("doc_id", text.alias("text"), F.regexp_count(text, F.lit(_WORD.replace("\\\\", "\\"))).cast("bigint").alias("n_words"))
    gate = " OR ".join(
        [f"contains(__low, {_text(k)})" for k in GATES]
        + [f"(contains(__low, 'cc') AND __low RLIKE '{_CC_BY}')", f"__low RLIKE '{_as_words(SHORT_GATES)}'"]
        + [f"(contains(__low, 'under') AND __low RLIKE '{_as_words(UNDER_GATES)}')"]
    )
    found = found.withColumn("__low", F.lower("text")).withColumn(
        "__words",
        F.expr(f"CASE WHEN {gate} THEN regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '{_WORD}', 0) END"),
    ).drop("__low", "text")
    found = found.withColumn("__norm", F.expr("concat(' ', array_join(__words, ' '), ' ')"))
    for k, (phrase, label) in enumerate(BASE.items()):
        words = phrase.split()
        same = " AND ".join(f"__words[i + {j}] = '{w}'" for j, w in enumerate(words))
        found = found.withColumn(
            f"__at{k}",
            F.expr(
                f"CASE WHEN contains(__norm, ' {phrase} ')"
                f" THEN filter(sequence(0, size(__words) - {len(words)}), i -> {same}) ELSE array() END"
            ),
        )
    # a version may be glued to a name, so the keyword of a rule with one is the beginning of a word
    table = ", ".join(
        f"named_struct('key', {_text(' ' + key + ('' if ' ?v?' in regex else ' '))}, 'regex', {_text('(?<= )' + regex + '(?= )')},"
        f" 'label', {_text(label)}, 'priority', {priority}, 'rule', {n})"
        for n, (label, key, regex, priority) in enumerate(rules())
    )
    # A long text is worked on by windows; a window's own detections start in its core, and all that could
    # contain them lie within its margins.
    windows = f"""
      transform(sequence(0, (size(__words) - 1) div {CORE}), k -> named_struct(
        'from', greatest(CAST(k * {CORE} - {MARGIN} AS INT), 0), 'core', CAST(k * {CORE} AS INT),
        'norm', concat(' ', array_join(slice(__words, greatest(CAST(k * {CORE} - {MARGIN} AS INT), 0) + 1,
          least(CAST(k * {CORE} AS INT), {MARGIN}) + {CORE + MARGIN}), ' '), ' ')))"""
    found = found.withColumn("__windows", F.expr(f"CASE WHEN size(__words) > 0 THEN {windows} ELSE array() END"))
    spaces = "(char_length({0}) - char_length(replace({0}, ' ', '')))"
    intervals = f"""
      aggregate(
        sequence(0, size(p.found) - 1),
        named_struct('at', -1, 'out', CAST(array() AS array<struct<start:int,past:int,over:int,rule:int,label:string>>)),
        (s, k) -> named_struct(
          'at', s.at + {spaces.format('p.parts[k]')} + {spaces.format('p.found[k]')},
          'out', array_append(s.out, named_struct(
            'start', s.at + {spaces.format('p.parts[k]')},
            'past', -(s.at + {spaces.format('p.parts[k]')} + {spaces.format('p.found[k]')} + 1),
            'over', -p.priority, 'rule', p.rule, 'label', p.label))),
        s -> s.out)"""
    hits = f"""
      array_sort(array_distinct(flatten(transform(
        filter(
          transform(
            filter(array({table}), r -> contains(w.norm, r.key)),
            r -> named_struct('found', regexp_extract_all(w.norm, r.regex, 0), 'regex', r.regex,
                              'priority', r.priority, 'rule', r.rule, 'label', r.label)),
          m -> size(m.found) > 0),
        m -> transform(array(named_struct('found', m.found, 'parts', split(w.norm, m.regex, -1),
                              'priority', m.priority, 'rule', m.rule, 'label', m.label)), p -> {intervals})[0]))))"""
    # Sorted by start, then from long to short, then from high to low priority: what contains a
    # detection comes before it, so the furthest end so far of each priority tells.
    tops = ", ".join(f"greatest(s.ends[{p - 1}], CASE WHEN d.over <= -{p} THEN -d.past ELSE -1 END)" for p in sorted(WEIGHTS))
    detections = f"""
      aggregate(
        {hits},
        named_struct('ends', array({', '.join('-1' for _ in WEIGHTS)}),
                     'out', CAST(array() AS array<struct<label:string,start:int,past:int,priority:int>>)),
        (s, d) -> named_struct(
          'ends', array({tops}),
          'out', CASE WHEN s.ends[-d.over - 1] >= -d.past OR w.from + d.start < w.core OR w.from + d.start >= w.core + {CORE} THEN s.out
                      ELSE array_append(s.out, named_struct(
                        'label', d.label, 'start', w.from + d.start, 'past', w.from - d.past, 'priority', -d.over)) END),
        s -> s.out)"""
    found = found.withColumn("detections", F.expr(f"flatten(transform(__windows, w -> {detections}))"))
    places = f"concat({', '.join(f'__at{k}' for k in range(len(BASE)))})"
    labels = "array_compact(array(" + ", ".join(
        f"CASE WHEN size(__at{k}) > 0 THEN {_text(label)} END" for k, label in enumerate(BASE.values())
    ) + "))"
    weight = "CASE d.priority " + " ".join(f"WHEN {p} THEN {w}D" for p, w in WEIGHTS.items()) + " END"
    return found.withColumn("__places", F.expr(places)).withColumn("__base", F.expr(labels)).select(
        "doc_id",
        "n_words",
        F.size("__places").cast("bigint").alias("n_base"),
        F.array_min("__places").cast("bigint").alias("first_word"),
        F.array_max("__places").cast("bigint").alias("last_word"),
        F.expr("array_join(array_sort(array_distinct(__base)), ',')").alias("base_labels"),
        F.expr("array_join(array_sort(array_distinct(concat(__base, transform(detections, d -> d.label)))), ',')").alias("labels"),
        F.expr(
            f"greatest(CASE WHEN size(__base) > 0 THEN {BASE_WEIGHT}D ELSE 0D END,"
            f" coalesce(array_max(transform(detections, d -> {weight})), 0D))"
        ).alias("score"),
        "detections",
    )
