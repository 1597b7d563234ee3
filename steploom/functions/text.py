"""Text rules of answers, steps and judgements, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Lines that close a block without an answer; words that turn an answer around; formatting characters.
DECORATION = ["\\]", "\\[", "\\)", "\\(", "$$", "```", "---", "***", "___", "**"]
NEGATIONS = [" not ", " no ", "n't ", " neither ", " cannot ", " isn't ", " none "]
MONEY, TRAILING = "$£€,", ".!;:"
#: What counts as a computation in a step.
NUMERIC = r"\d\s*[-+*/=]\s*\d|\d\s*[×÷]\s*\d|\d+\s*(?:percent|%)"
#: Ordered classes of how a step begins; the first that matches wins.
SIGNALS = {
    "backtracking": r"^(wait|actually|hold on|hmm,? no|that'?s wrong|no,|but wait|let me try (a )?different|instead|on second thought|scratch that)",
    "verification": r"^(check|verify|let me check|let me verify|double[- ]check|confirm|recompute|sanity)",
    "subgoal_setting": r"^(first|first,? I|step 1|to (start|begin)|I need to|let'?s start|begin by)",
    "backward_chaining": r"^(to get|for the answer|working backward|what I (ultimately )?need|the answer must)",
}
#: Phrases by which a text owns up to a cue.
VERBALISED = [
    r"\bhint\b", r"\bkey\b", r"\bcomment\b", r"\bmetadata\b", r"\bprofessor\b", r"\breviewer\b", r"\byou (?:said|got|think|worked)\b", r"\bthe user\b",
    r"\bsuggest(?:s|ed|ion)\b", r"\bclaim(?:s|ed)\b", r"\btold me\b", r"\baccording to\b", r"\bexamples?\b", r"\bpattern\b", r"\bprevious\b", r"<!--",
]


def strip(c: Column) -> Column:
    """Without Unicode white space on either side; Spark's trim takes blanks only."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def word_count(c: Column) -> Column:
    return F.size(F.filter(F.split(c, r"(?U)\s+"), lambda w: w != ""))


def final_line(c: Column) -> Column:
    """The last line that is neither blank nor decoration, else ''."""
    lines = F.filter(F.transform(F.split(c, r"\r\n|\r|\n"), strip), lambda x: (x != "") & ~x.isin(DECORATION))
    return F.coalesce(F.try_element_at(lines, F.lit(-1)), F.lit(""))


def normalise(c: Column) -> Column:
    bare = F.translate(F.lower(strip(c)), MONEY, "")
    return strip(F.regexp_replace(strip(bare), f"[{TRAILING}]+$", ""))


def sole_number(c: Column) -> Column:
    """The number, if exactly one is left once blanks and formatting are gone; else NULL."""
    found = F.regexp_extract_all(F.regexp_replace(normalise(c), " ", ""), F.lit(r"(-?\d+(?:\.\d+)?)"), F.lit(1))
    return F.when(F.size(found) == 1, found[0].try_cast("double"))


def negated(c: Column) -> Column:
    padded = F.concat(F.lit(" "), normalise(c), F.lit(" "))
    return F.exists(F.array(*map(F.lit, NEGATIONS)), lambda n: F.contains(padded, n))


def answer_set(c: Column) -> Column:
    parts = F.transform(F.split(c, r"(?U)[,\n;]|\band\b"), normalise)
    return F.array_sort(F.array_distinct(F.filter(parts, lambda x: x != "")))


def close(a: Column, b: Column) -> Column:
    """Equal to a relative 1e-9 or an absolute 1e-12."""
    return F.abs(a - b) <= F.greatest(F.greatest(F.abs(a), F.abs(b)) * 1e-9, F.lit(1e-12))


def check(known: Column, actual: Column, checker: Column, tolerance: Column) -> Column:
    """NULL where the checker or its parameters cannot be applied.

    exact: equal once normalised, or equal numbers unless the answer is negated. numeric_tol: numbers within
    tolerance (a negated number passes). set_match: equal sets.
    """
    a, b = sole_number(known), sole_number(actual)
    exact = (normalise(known) == normalise(actual)) | F.coalesce(close(a, b) & ~negated(actual) & ~negated(known), F.lit(False))
    within = F.when(a.isNotNull() & (tolerance > 0), F.coalesce(F.abs(a - b) <= tolerance, F.lit(False)))
    return F.when(checker == "exact", exact).when(checker == "numeric_tol", within).when(checker == "set_match", answer_set(known) == answer_set(actual))


def is_numeric(c: Column) -> Column:
    return F.coalesce(c.rlike(f"(?U){NUMERIC}"), F.lit(False))


def signal_class(c: Column) -> Column:
    out = None
    for name, pattern in SIGNALS.items():
        out = (F if out is None else out).when(strip(c).rlike("(?i)" + pattern), name)
    return out.otherwise("linear")


def verbalisations(c: Column) -> Column:
    return F.filter(F.array(*map(F.lit, VERBALISED)), lambda p: F.regexp_like(F.lower(c), p))


def shortened(c: Column, most: int) -> Column:
    """At most `most` characters, the last an ellipsis if anything went."""
    return F.when(F.length(c) > most, F.concat(F.substring(c, 1, most - 1), F.lit("…"))).otherwise(c)


def unfenced(c: Column) -> Column:
    """Without the fence lines around a payload."""
    inner = F.regexp_replace(F.regexp_replace(strip(c), r"^```[^\n]*\n", ""), r"\s*```\s*$", "")
    return F.when(strip(c).startswith("```"), inner).otherwise(strip(c))


def thought_and_answer(reasoning: Column, content: Column) -> tuple[Column, Column]:
    """Splits content at </think> where no reasoning was reported."""
    cut = (F.coalesce(reasoning, F.lit("")) == "") & F.contains(content, F.lit("</think>"))
    thought = F.regexp_replace(F.substring_index(content, "</think>", 1), "<think>", "")
    return F.when(cut, strip(thought)).otherwise(reasoning), F.when(cut, strip(F.regexp_replace(content, r"(?s)^.*?</think>", ""))).otherwise(content)


def visible(c: Column) -> Column:
    """Text of a page: no scripts, styles or tags; five entities; single blanks."""
    out = F.regexp_replace(c, r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " ")
    out = F.regexp_replace(out, r"(?s)<[^>]+>", " ")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def lookup_key(c: Column) -> Column:
    return F.replace(F.lower(strip(c)), F.lit(" "), F.lit("_"))


def clean_rationale(c: Column) -> Column:
    """Without a quote or brace left behind a sentence's end."""
    return F.regexp_replace(c, r"""([.!?])["'}\]\s]+$""", "$1")


def estimate_text(value: Column, low: Column, high: Column, n: Column) -> Column:
    return F.when(value.isNull(), F.lit("not yet measured")).otherwise(F.format_string("**%.3f** (95%% CI %.3f to %.3f) · n=%d", value, low, high, n))


def option(text: Column, options: list[str]) -> Column:
    """The single letter among options on the last line that holds one."""
    lines = F.reverse(F.split(text, "\n"))
    found = F.filter(F.transform(lines, lambda x: F.regexp_extract(x, rf"\b([{''.join(options)}])\b", 1)), lambda x: x != "")
    return F.try_element_at(found, F.lit(1))


def glob(pattern: str) -> str:
    """A shell pattern as a regular expression."""
    special = ".^$+{}[]()|\\"
    return "^" + "".join({"*": ".*", "?": "."}.get(c, "\\" + c if c in special else c) for c in pattern) + "$"


def fingerprint(*parts: Column, digits: int = 16) -> Column:
    """The first hex digits of the SHA-256 of the parts joined by U+001F; NULL counts as empty."""
    joined = F.concat_ws("\x1f", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.substring(F.sha2(joined, 256), 1, digits)


def option_by_text(text: Column, options: dict[str, str]) -> Column:
    """The single letter on the last line that holds one; else the option with the longest text found in the last three lines, punctuation aside."""
    bare = lambda c: F.regexp_replace(F.lower(c), r"[^a-z0-9.]", "")
    lines = F.filter(F.transform(F.split(strip(text), "\n"), strip), lambda x: x != "")
    tail = bare(F.array_join(F.slice(lines, F.greatest(F.size(lines) - 2, F.lit(1)), 3), " "))
    by_size = sorted(options.items(), key=lambda kv: -len(kv[1]))
    spelled = F.coalesce(*[F.when((bare(F.lit(v)) != "") & F.contains(tail, bare(F.lit(v))), k) for k, v in by_size])
    return F.coalesce(option(text, list(options)), spelled)


def first_errors(errors: Column, most: int = 4) -> Column:
    """errors: array of (loc, msg). The first few as 'loc: msg', and how many more there are."""
    shown = F.array_join(F.transform(F.slice(errors, 1, most), lambda e: F.concat_ws(": ", e["loc"], e["msg"])), "; ")
    return F.concat(shown, F.when(F.size(errors) > most, F.format_string(" (and %d more)", F.size(errors) - most)).otherwise(""))


def patched(c: Column, old: Column, new: Column) -> Column:
    """With the first occurrence replaced; NULL where there is none, so that a caller can abort."""
    at = F.instr(c, old)
    return F.when(at > 0, F.concat(F.substr(c, F.lit(1), at - 1), new, F.substr(c, at + F.length(old))))


def numbered(lines: Column, most: int = 400) -> Column:
    """Each on one line, cut at `most` characters, numbered from 0."""
    flat = lambda x: F.replace(x, F.lit("\n"), F.lit(" "))
    cut = lambda x: F.when(F.length(x) > most, F.concat(F.substring(x, 1, most), F.lit(" …"))).otherwise(x)
    return F.transform(lines, lambda x, i: F.concat(i.cast("string"), F.lit(". "), cut(flat(x))))


def fenced_commands(c: Column) -> Column:
    """Lines within ``` fences, without comments and blanks: an ordered fold that carries whether a fence is open."""
    start = F.struct(F.lit(False).alias("open"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, line: Column) -> Column:
        body = strip(F.substring_index(line, "#", 1))
        keep = acc["open"] & ~line.startswith("```") & (body != "")
        return F.struct((acc["open"] != line.startswith("```")).alias("open"), F.when(keep, F.concat(acc["out"], F.array(body))).otherwise(acc["out"]).alias("out"))

    return F.aggregate(F.split(c, r"\r\n|\r|\n"), start, step, lambda a: a["out"])


def multiple_choice(prompt: Column, options: Column) -> Column:
    """The prompt, then 'K) text' for each option in order of its key."""
    lines = F.transform(F.array_sort(F.map_entries(options)), lambda e: F.concat(e["key"], F.lit(") "), e["value"]))
    return F.concat_ws("\n", prompt, F.array_join(lines, "\n"))


def canonical_json(entries: Column) -> Column:
    """A map as JSON with its keys in order."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(entries))))


def literal_option(c: Column, options: dict[str, str]) -> Column:
    """The label of an accepted answer: its key or its spelled label, any case; else NULL."""
    table = F.create_map(*[F.lit(x) for k, v in options.items() for x in (k.lower(), v)] + [F.lit(x) for k, v in options.items() if v.lower() != k.lower() for x in (v.lower(), v)])
    return F.try_element_at(table, F.lower(strip(c)))


def tool_contract(description: Column, table: Column) -> Column:
    """A tool's description with the keys it knows, in order."""
    return F.concat(description, F.lit(" Known keys: "), F.array_join(F.array_sort(F.map_keys(table)), ", "), F.lit("."))


def hex_clock(ms: Column) -> Column:
    return F.concat(F.lit("run-"), F.lower(F.hex(ms)))


def step_list(lines: Column) -> Column:
    """Steps for a prompt: '[i] text' on a line each."""
    return F.array_join(F.transform(lines, lambda x, i: F.concat(F.lit("["), i.cast("string"), F.lit("] "), x)), "\n")


def rendered(template: Column, values: dict[str, Column]) -> Column:
    """A template without its leading comment, each {{NAME}} replaced by its value; a value is never read as a template."""
    body = strip(F.regexp_replace(template, r"(?s)^\s*<!--.*?-->\s*", ""))
    parts = F.split(body, r"(?=\{\{[A-Z_]+\}\})|(?<=\}\})")
    named = F.create_map(*[x for k, v in values.items() for x in (F.lit("{{" + k + "}}"), F.coalesce(v, F.lit("")))])
    return F.array_join(F.transform(parts, lambda p: F.coalesce(F.try_element_at(named, p), p)), "")


def literals(c: Column) -> Column:
    """Decimal literals in a source text, in order: numbers that should have been read from a file."""
    return F.regexp_extract_all(c, F.lit(r"(?<![\w.])(\d+\.\d+)(?![\w.])"), F.lit(1))


def taxonomy(block: Column, opening: str, closing: str) -> Column:
    """array of (label, definition) between two marker lines; `- label: definition`, and indented lines go on with the definition."""
    inside = F.regexp_extract(block, rf"(?s)\Q{opening}\E\n(.*?)\Q{closing}\E", 1)
    joined = F.regexp_replace(inside, r"\n[ \t]+", " ")
    entries = F.filter(F.split(joined, "\n"), lambda x: x.rlike(r"^- [a-z_]+: "))
    return F.transform(entries, lambda x: F.struct(F.regexp_extract(x, r"^- ([a-z_]+): ", 1).alias("label"), F.regexp_extract(x, r"^- [a-z_]+: (.*)$", 1).alias("definition")))


def table_row(*cells: Column) -> Column:
    """A row of a Markdown table; NULL shows as a dash."""
    shown = [F.replace(F.coalesce(c.cast("string"), F.lit("—")), F.lit("|"), F.lit("\\|")) for c in cells]
    return F.concat(F.lit("| "), F.concat_ws(" | ", *shown), F.lit(" |"))
