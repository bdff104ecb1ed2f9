"""Text expressions: tags, queries, answers, normalisation, previews, token counts. All stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The tag vocabulary of responses.
THINK = ("<think>", "</think>")
ANSWER = ("<answer>", "</answer>")
QUERY = ("<|begin_of_query|>", "<|end_of_query|>")
DOCS = ("<|begin_of_documents|>", "<|end_of_documents|>")
SEARCH_KINDS = ("1-hop", "2-hop", "pagerank", "similar")
#: Spellings of the search kinds.
ALIASES = {
    "one_hop": ["1-hop", "1 hop", "1hop", "one-hop", "one hop"],
    "two_hop": ["2-hop", "2 hop", "2hop", "two-hop", "two hop"],
    "pagerank": ["pagerank", "page rank", "pr"],
    "similar": ["similar", "sim", "similarity"],
}
#: Fixed value: the ASCII and CJK marks that a question key does not hold, as a character class.
QUESTION_MARKS = r"""[,.:"'\[\]\-=+\\|!@#$%^&*();<>?/{}\x{FF01}\x{FFE5}\x{2026}\x{FF08}\x{FF09}\x{2014}\x{FF1A}\x{201D}\x{201C}\x{300A}\x{300B}\x{FF1F}]"""


def quoted(s: str) -> str:
    """A literal inside a Java regular expression (and RE2)."""
    return "".join("\\" + c if c in r"\^$.|?*+()[]{}" else c for c in s)


def body_pattern(tags: tuple[str, str]) -> str:
    return f"(?s){quoted(tags[0])}(.*?){quoted(tags[1])}"


def squeeze(c: Column) -> Column:
    """Outer white space removed, inner runs of it one blank."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def first_body(c: Column, tags: tuple[str, str]) -> Column:
    """Text between the first opening tag and the next closing one, stripped; null where there is none."""
    p = F.lit(body_pattern(tags))
    return F.when(F.regexp_like(c, p), strip(F.regexp_extract(c, body_pattern(tags), 1)))


def last_body(c: Column, tags: tuple[str, str]) -> Column:
    """Text after the last opening tag up to the next closing one; the whole text where there is no tag."""
    return F.substring_index(F.substring_index(c, tags[0], -1), tags[1], 1)


def boxed(c: Column) -> Column:
    r"""The content of the last \boxed{...} with balanced braces, null where there is none or it is not closed.

    A fold over the characters after the last opening carries the depth, so nesting of any depth is followed."""
    tail = F.substring_index(c, "\\boxed{", -1)
    folded = F.aggregate(
        F.split(tail, ""),
        F.struct(F.lit(1).alias("depth"), F.lit("").alias("kept")),
        lambda s, ch: F.struct(
            F.when(s["depth"] == 0, 0).when(ch == "{", s["depth"] + 1).when(ch == "}", s["depth"] - 1).otherwise(s["depth"]).cast("int").alias("depth"),
            F.when((s["depth"] == 0) | ((ch == "}") & (s["depth"] == 1)), s["kept"]).otherwise(F.concat(s["kept"], ch)).alias("kept"),
        ),
    )
    return F.when(F.contains(c, F.lit("\\boxed{")) & (folded["depth"] == 0), folded["kept"])


def last_query(c: Column) -> Column:
    """The query after the last opening tag: quotes dropped, white space squeezed, null if empty or not closed."""
    tail = F.substring_index(c, QUERY[0], -1)
    body = squeeze(F.replace(F.substring_index(tail, QUERY[1], 1), F.lit('"'), F.lit("")))
    return F.when(F.contains(c, F.lit(QUERY[0])) & F.contains(tail, F.lit(QUERY[1])) & (body != ""), body)


def search_kind(query: Column) -> Column:
    """one_hop, two_hop, pagerank or similar from the prefix of a query; anything else is similar."""
    prefix = F.lower(F.trim(F.regexp_extract(query, r"(?s)^([a-zA-Z0-9\- ]+?):(.*)$", 1)))
    out = F.lit("similar")
    for kind, names in ALIASES.items():
        out = F.when(prefix.isin(names), F.lit(kind)).otherwise(out)
    return out


def search_text(query: Column) -> Column:
    """The query without its prefix; an unknown prefix is dropped too, a query without one stays."""
    p = r"(?s)^([a-zA-Z0-9\- ]+?):(.*)$"
    return F.when(F.regexp_like(query, F.lit(p)), F.trim(F.regexp_extract(query, p, 2))).otherwise(F.trim(query))


def search_scope(query: Column) -> Column:
    """A phrase that describes where a query searches."""
    q = F.lower(F.trim(query))
    starts = lambda *xs: F.expr("false") if not xs else _any([q.startswith(x) for x in xs])
    return (
        F.when(starts("1-hop", "1 hop", "1hop", "one-hop", "one hop"), F.lit("direct neighbours"))
        .when(starts("2-hop", "2 hop", "2hop", "two-hop", "two hop"), F.lit("neighbours of neighbours"))
        .when(starts("pagerank", "page rank", "pr", "global"), F.lit("globally important nodes"))
        .when(starts("similar", "sim", "most similar"), F.lit("semantically similar nodes"))
        .otherwise(F.lit("the graph"))
    )


def _any(cs: list[Column]) -> Column:
    out = cs[0]
    for c in cs[1:]:
        out = out | c
    return out


def label_key(c: Column) -> Column:
    """Lower case without any white space."""
    return F.regexp_replace(F.lower(c), r"(?U)\s+", "")


def yes_no(c: Column) -> Column:
    """yes, no or null from a free answer, by its letters only."""
    letters = F.regexp_replace(F.lower(c), "[^a-z]", "")
    return F.when(letters.isin("yes", "edge", "true"), F.lit("yes")).when(letters.isin("no", "false"), F.lit("no"))


def answer_key(c: Column) -> Column:
    """Reading-comprehension normalisation: lower case, no punctuation, no articles, single blanks."""
    s = F.lower(F.replace(c, F.lit("_"), F.lit(" ")))
    s = F.regexp_replace(s, r"[!-/:-@\[-`{-~]", " ")
    return squeeze(F.regexp_replace(s, r"\b(a|an|the)\b", " "))


def truth_word(c: Column) -> Column:
    return F.when(c == "True", F.lit("yes")).when(c == "False", F.lit("no")).otherwise(c)


def covers(gold: Column, predicted: Column) -> Column:
    """Does every word of gold stand among the words of predicted, in any order?"""
    return F.forall(F.split(gold, " "), lambda w: F.array_contains(F.split(predicted, " "), w))


def question_key(c: Column) -> Column:
    """Lower case, ASCII and CJK marks to blanks, lines `import x as y` dropped, single blanks."""
    s = F.regexp_replace(F.lower(c), QUESTION_MARKS, " ")
    return squeeze(F.regexp_replace(s, r"(?U)import\s[a-z.]+\sas\s[a-z.]+\n", " "))


def strip_runs(c: Column, tokens: list[str]) -> Column:
    """Without leading and trailing runs of the given tokens."""
    any_of = "|".join(quoted(t) for t in tokens)
    return F.regexp_replace(c, f"^({any_of})+|({any_of})+$", "")


def chat_part(c: Column, role: str, closing: str) -> Column:
    """The text after the last mark of a role, up to the closing mark."""
    return F.trim(F.substring_index(F.substring_index(c, role, -1), closing, 1))


def preview(c: Column, n: int) -> Column:
    """The first n characters and three dots, if the text is longer (so up to n + 3)."""
    return F.when(F.length(c) > n, F.concat(F.left(c, F.lit(n)), F.lit("..."))).otherwise(c)


def preview_within(c: Column, n: int = 480) -> Column:
    """Stripped; of a longer text n - 3 characters and three dots (so at most n)."""
    s = strip(c)
    return F.when(F.length(s) > n, F.concat(F.left(s, F.lit(n - 3)), F.lit("..."))).otherwise(s)


def token_count(c: Column) -> Column:
    """Runs of anything but white space."""
    return F.size(F.filter(F.split(c, r"(?U)\s+"), lambda t: t != ""))


def occurrences(c: Column, tag: str) -> Column:
    """How often a literal occurs, without overlaps."""
    return ((F.length(c) - F.length(F.replace(c, F.lit(tag), F.lit("")))) / F.lit(len(tag))).cast("int")


def think_segments(c: Column) -> Column:
    """The first think block without document blocks, cut at its queries; null without a block."""
    think = F.regexp_extract(c, body_pattern(THINK), 1)
    clean = F.regexp_replace(think, body_pattern(DOCS).replace("(.*?)", ".*?"), " ")
    parts = F.split(clean, body_pattern(QUERY).replace("(.*?)", ".*?"))
    return F.when(F.regexp_like(c, F.lit(body_pattern(THINK))), parts)


def used_search_kinds(c: Column, ordered: bool) -> Column:
    """How many search kinds occur; ordered: the closing tag must follow the opening one, else both anywhere will do."""
    total = F.lit(0)
    for k in SEARCH_KINDS:
        begin = QUERY[0] + k
        hit = F.regexp_like(c, F.lit(f"(?s){quoted(begin)}.*?{quoted(QUERY[1])}")) if ordered else F.contains(c, F.lit(begin)) & F.contains(c, F.lit(QUERY[1]))
        total = total + F.coalesce(hit, F.lit(False)).cast("int")
    return total


def neighbour_lines(texts: Column, empty: str = "None\n") -> Column:
    """(1) text, (2) text ... one a line, a leading ordinal of the text dropped; the given word for an empty list."""
    lines = F.transform(texts, lambda t, i: F.concat(F.lit("("), (i + 1).cast("string"), F.lit(") "), F.regexp_replace(t, r"^\s*\d+\s+", ""), F.lit("\n")))
    return F.when(F.size(texts) > 0, F.array_join(lines, "")).otherwise(F.lit(empty))


def split_marker(c: Column, marker: str, part: int) -> Column:
    return F.split_part(c, F.lit(marker), F.lit(part))


def filled_reward(template: str, text: Column, reward: Column) -> Column:
    """A template with {reward} (two decimals) replaced before {input}."""
    return F.replace(F.replace(F.lit(template), F.lit("{reward}"), F.format_string("%.2f", reward)), F.lit("{input}"), text)


def with_end(c: Column, end: str) -> Column:
    """Trailing line breaks removed and the end mark there once."""
    s = F.regexp_replace(c, r"\n+$", "")
    return F.when(s.endswith(end), s).otherwise(F.concat(s, F.lit(" "), F.lit(end)))


def relation_of(dataset: Column) -> Column:
    """What an edge of a dataset stands for, by its name."""
    d = F.lower(dataset)
    return (
        F.when(d.contains("paper") | d.contains("arxiv") | d.contains("cite") | d.contains("med"), F.lit("citation"))
        .when(d.contains("shop") | d.contains("amazon") | d.contains("product"), F.lit("co-purchase"))
        .when(d.contains("forum") | d.contains("reddit") | d.contains("board"), F.lit("shared discussion"))
        .otherwise(F.lit("link"))
    )
