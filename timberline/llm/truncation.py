"""Texts that were cut off on the way into a feed.

A stack automaton reads each text whole: a header block, prose, the public formats of diffs and binary
patches, and what follows them. In prose its stack holds open brackets, quotes, elements and code fences over
line ends; lines of a hunk are fragments of a file, so there the stack holds the marks of one line. A hunk
owes the lines that it announces. Torn escapes, entities and multibyte sequences at the end tell by
themselves. What the structure doesn't decide is held against baselines over the whole corpus, all of them
shares: how the texts of a source end, at which lengths a source cuts, how lines of a kind end, and how rare
a last word is beside the longer words that it begins.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import Workspace, broadcast_if_small, pick

_HUNK = re.compile(r"@@ -\d+(?:,(\d+))? \+\d+(?:,(\d+))? @@")
_DIFF = re.compile(r"diff --git a/(.+) b/(.+)$")
_INDEX = re.compile(r"index [0-9a-f]{4,}\.\.[0-9a-f]{4,}(?: \d{6})?$")
_BINARY = re.compile(r"Binary files .+ and (\S+) differ$")
_MODE = re.compile(r"(?:old mode|new mode|new file mode|deleted file mode|similarity index|dissimilarity index|rename|copy) ?")
_BLOB = re.compile(r"(?:literal|delta) \d+$")
_FIELD = re.compile(r"[A-Za-z][A-Za-z0-9-]*:\s|commit [0-9a-f]+$")
_LETTERS = re.compile(r"[^\W\d_]+")
#: Words as they are counted: the ending of a file's name is another word than the letter it looks like.
_WORDS = re.compile(r"(?:(?<=\w)\.)?[^\W\d_]+")
_CLOSERS = {"(": ")", "[": "]", "<": ">", "{": "}"}
_ELEMENT = re.compile(r"<(/?)([A-Za-z][A-Za-z0-9-]*)((?:\s+[\w:-]+(?:\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\s\"'<>]+))?)*)\s*(/?)>")
_TORN = re.compile(
    r"(?<!\\)(?:\\\\)*\\(?:x[0-9a-fA-F]?|u[0-9a-fA-F]{0,3}|U[0-9a-fA-F]{0,7}|u\{[0-9a-fA-F]*)?$"  # escapes of strings
    r"|(?:%[0-9A-Fa-f]{2})+%[0-9A-Fa-f]?$"  # percent-encoded bytes
    r"|&(?:#(?:\d*|[xX][0-9a-fA-F]*)|(?:am|l|g|quo|apo|nbs)[a-z]?)$"  # entities
    r"|[�\ud800-\udfff‍]$"  # halves of characters and of joined ones
    r"|[\xc2-\xdf\xe0-\xef][\x80-\xbf][\xc2-\xf4][\x80-\xbf]?$"  # bytes of characters read one by one
)
# Elements of markup that have no end tag, and common ones that have one.
_EMPTY = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
_COMMON = {"a", "b", "body", "code", "div", "em", "h1", "h2", "h3", "head", "html", "i", "li", "ol", "p", "pre", "span", "strong", "table", "td", "th", "tr", "ul"}

#: A length counts as a limit of a source if more than this share of the source's texts that are cut by
#: structure have it (one of them may be chance), and this share of the texts of that length are cut.
LIMIT_OF_CUTS, LIMIT_SHARE = 0.02, 0.2
#: An ending is the terminator of a source if this share of its texts with content has it.
SIGNED_SHARE = 0.5
#: A line ends unlike its kind if at most this share of the lines ends like it, of which a quarter of a line
#: counts as seen beforehand.
KIND_SHARE, KIND_PRIOR = 0.005, 0.25
#: A last line after a diff is finished if this share of its kind ends with the same mark.
CLOSED_SHARE = 0.5
#: A last word is the beginning of a longer one if it stands inside texts at most this often per occurrence of
#: the longer words that it begins. Both counts grow with the corpus, so the rule is the same at every size.
WORD_SHARE = 0.05
#: A word is common if messages hold it this often per text with content.
COMMON_SHARE = 0.002
MAX_BROADCAST_ROWS = 100_000


def final_class(line: str) -> str:
    """How a line ends: with a letter, a digit, or a certain other character."""
    c = line.rstrip()[-1:]
    return "a" if c.isalpha() else "0" if c.isdigit() else c


def shape_of(line: str) -> str:
    """The line with runs of letters as a and runs of digits as 0, cut short where that is long."""
    return re.sub(r"\d+", "0", re.sub(r"[^\W\d_]+", "a", line.strip()))[:40]


def endings(content: list[str]) -> list[str]:
    """Shapes of lines that a line of marks alone sets off, among the last four lines; the last one first, with
    an empty one in its place if the text ends otherwise."""
    found = ["\n".join(map(shape_of, content[n - 1 : n + 1])) if not re.search(r"\w", content[n - 1]) else "" for n in range(len(content) - 1, max(0, len(content) - 4), -1)]
    return found or [""]


def open_marks(line: str) -> list[str]:
    """What is still open at the end of the line: brackets, quotes, back-quotes, tags.

    An apostrophe after a letter or digit opens nothing; ``<`` opens only before a letter, so comparisons,
    arrows and assignments don't count; a closing mark that matches nothing is skipped. Braces may stay open.
    """
    stack: list[str] = []
    before = " "
    for i, c in enumerate(line):
        if stack and stack[-1] in "\"'`":
            if c == stack[-1] and before != "\\":
                stack.pop()
        elif c in "\"`" or c == "'" and not before.isalnum():
            stack.append(c)
        elif c in "([" or c == "<" and before != "<" and line[i + 1 : i + 2].isalpha():
            stack.append(c)
        elif stack and _CLOSERS.get(stack[-1]) == c:
            stack.pop()
        before = c
    return stack


def open_prose(text: str) -> list[str]:
    """What is still open at the end of prose, by one stack over all of its lines.

    A quotation or bracket may go on over line ends, but quotes, round and angle brackets don't outlive a
    blank line, and a single quote not its line; braces, square brackets, elements and code fences do. Marks
    inside a fence don't count. Elements count if they have attributes or a common name.
    """
    stack: list[str] = []
    lines = text.split("\n")
    for n, line in enumerate(lines):
        bare = line.strip()
        if bare.startswith(("```", "~~~")) and "`" not in bare[3:]:
            fence = bare[:3]
            if fence in stack:
                del stack[stack.index(fence) :]
            else:
                stack.append(fence)
            continue
        if "```" in stack or "~~~" in stack:
            continue
        if not bare:
            stack = [m for m in stack if m in "[{" or len(m) > 1]
            continue
        at, before = 0, " "
        while at < len(line):
            c = line[at]
            top = stack[-1] if stack else ""
            if top in ("\"", "'", "`"):
                if c == top and before != "\\":
                    stack.pop()
            elif c == "<":
                m = _ELEMENT.match(line, at)
                if m:
                    end, name, attributes, alone = m[1], m[2].lower(), m[3], m[4]
                    mark = "<" + name + ">"
                    if end:
                        if mark in stack:
                            del stack[len(stack) - 1 - stack[::-1].index(mark) :]
                    elif not alone and name not in _EMPTY and (name in _COMMON or "=" in attributes):
                        stack.append(mark)
                    at, before = m.end(), ">"
                    continue
                if before != "<" and line[at + 1 : at + 2].isalpha():
                    stack.append(c)
            elif c in "\"`" or c == "'" and not before.isalnum():
                stack.append(c)
            elif c in "([{":
                stack.append(c)
            elif top and _CLOSERS.get(top) == c:
                stack.pop()
            before, at = c, at + 1
        if stack and stack[-1] == "'" and n + 1 < len(lines):
            stack.pop()
    return stack


def _whole_blob_line(line: str) -> bool:
    """A line of a binary patch: a letter for the number of bytes, then five signs for each four of them."""
    c = line[:1]
    n = ord(c) - 64 if "A" <= c <= "Z" else ord(c) - 70 if "a" <= c <= "z" else 0
    return 0 < n and len(line) == 1 + 5 * -(-n // 4)


def read_text(text: str) -> dict:
    """Facts about one text with content. ``cut``: reason why it is cut by structure alone, or ''."""
    ends_line = text.endswith("\n")
    lines = text.replace("\r\n", "\n").split("\n")
    if ends_line:
        lines.pop()
    lines = [x.rstrip("\r") for x in lines]
    state, old, new, ext, blobs, whole = "message", 0, 0, "", 0, True
    kinds: list[tuple[str, str]] = []  # (kind, line) of each line outside the formats of diffs
    prose: list[str] = []
    # a header: fields line by line up to a blank one
    fields = next((n for n, x in enumerate(lines) if not _FIELD.match(x)), len(lines))
    header = fields if fields >= 2 or lines[0].startswith("commit ") and fields else 0
    bare_header = header > 0 and not any(x.strip() for x in lines[header:])
    last_state = "message"
    for n, line in enumerate(lines):
        if state == "hunk" and (old > 0 or new > 0):
            mark = line[:1]
            old -= mark != "+"
            new -= mark != "-"
            kinds.append((ext, line[1:]))
            last_state = "hunk"
            continue
        if line.startswith("diff --git"):
            m = _DIFF.match(line)
            state, blobs = "opened", 0
            path = m[1] if m else ""
            ext = "." + path.rsplit(".", 1)[-1] if "." in path else "?"
            last_state = "diff part"
        elif state in ("opened", "index", "minus", "plus", "binary", "hunk") and line.startswith("@@"):
            m = _HUNK.match(line)
            if m:
                old, new, state, last_state = int(m[1] or 1), int(m[2] or 1), "hunk", "hunk"
            else:
                last_state = "hunk part"
        elif state == "opened" and _INDEX.match(line):
            state, last_state = "index", "index part"
        elif state == "opened" and _MODE.match(line):
            last_state = "mode"
        elif state in ("opened", "index") and line.startswith("--- "):
            state, last_state = "minus", "minus part"
        elif state == "minus" and line.startswith("+++ "):
            state, last_state = "plus", "plus part"
        elif state in ("opened", "index") and line.startswith("Binary"):
            state = "after"
            last_state = "done" if _BINARY.match(line) else "binary part"
        elif state in ("opened", "index") and line.startswith("GIT binary"):
            state, last_state = "binary", "binary part"
        elif state == "binary" and (blobs < 2 or not whole):
            # two blobs, there and back, each of whole lines, with a blank one between them
            if _BLOB.match(line):
                blobs, whole = blobs + 1, False
            elif line.strip():
                whole = _whole_blob_line(line)
            last_state = "done" if whole and blobs == 2 else "binary part"
        elif not line.strip():
            pass
        elif state == "binary" and _whole_blob_line(line):
            last_state = "done"
        elif state == "message":
            last_state = "message"
            if n >= header:
                kinds.append(("message" if prose and any(x.strip() for x in prose) else "title", line))
        elif state in ("opened", "index", "minus", "plus"):
            last_state = state + " part"
        else:
            last_state, state = "after", "after"
            kinds.append(("after", line))
        if state == "message" and n >= header:
            prose.append(line)
    content = [x for x in lines if x.strip()]
    last, tail = content[-1], lines[-1]
    cut = ""
    if state == "hunk" and (old > 0 or new > 0):
        cut = "hunk owes lines"
    elif last_state.endswith(" part"):
        cut = "diff stops: " + last_state
    elif bare_header:
        cut = "header without message"
    elif not ends_line:
        marks = open_prose("\n".join(prose)) if last_state == "message" else open_marks(tail[1:]) if last_state == "hunk" else []
        if _TORN.search(text[-16:]) and (last_state != "hunk" or marks or tail[-1:] != "\\"):
            cut = "torn escape or character"
        elif marks:
            cut = "open mark"
        elif last_state == "message" and not tail.strip():
            cut = "blank start of a line"
        elif last_state == "message" and tail.endswith(" ") and tail.rstrip()[-1:].isalnum():
            cut = "blank after a word"
    elif last_state == "message" and any(len(m) > 1 for m in open_prose("\n".join(prose))):
        cut = "open element or fence"
    words = _WORDS.findall(last)
    done, _, rest = last.rpartition(". ")
    fragment = sorted({w.lower() for w in _WORDS.findall(rest)}) if last_state == "message" and not ends_line and done.strip() and rest.strip() and rest.rstrip()[-1].isalnum() else None
    ends_in_word = not ends_line and bool(last) and last.rstrip()[-1:].isalpha() and bool(words)
    judged = last_state in ("message", "hunk", "after") and bool(kinds)
    return {
        "cut": cut, "ends_line": ends_line, "kinds": kinds, "last_state": last_state, "endings": endings(content),
        "word": words[-1].lower() if ends_in_word and last_state in ("message", "hunk") else None,
        "region": last_state if last_state in ("message", "hunk", "after") else None, "fragment": fragment,
        "kind": kinds[-1][0] if judged and not ends_line else None,
        "head": _head(kinds[-1][1]) if judged else None, "final": final_class(kinds[-1][1]) if judged else None,
    }


def _head(line: str) -> str:
    """The first sign and the first word of a line: what kind of line it is."""
    s = line.strip()
    m = _LETTERS.search(s)
    return (s[:1] if s[:1] and not s[0].isalnum() else "") + (m[0].lower() if m else "")


_FACTS = "tag string, doc_id {id}, source {source}, cut string, ends_line boolean, endings array<string>, n_chars int, n_bytes int, region string, fragment array<string>, word string, kind string, head string, final string, n bigint"


def _facts(docs: DataFrame) -> DataFrame:
    """Rows tagged doc (one per text with content), word and line (partial counts of a batch)."""
    ids, sources = docs.schema["doc_id"].dataType, docs.schema["source"].dataType
    names = [x.strip().split(" ")[0] for x in _FACTS.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        id_type = source_type = None
        words: Counter = Counter()
        ends: Counter = Counter()

        def emit(cols: dict, size: int) -> pa.RecordBatch:
            types = {"ends_line": pa.bool_(), "n_chars": pa.int32(), "n_bytes": pa.int32(), "n": pa.int64(), "doc_id": id_type, "source": source_type, "fragment": pa.list_(pa.string()), "endings": pa.list_(pa.string())}
            return pa.RecordBatch.from_arrays([pa.array(cols[c], types.get(c, pa.string())) if c in cols else pa.nulls(size, types.get(c, pa.string())) for c in names], names=names)

        def counts() -> Iterator[pa.RecordBatch]:
            yield emit({"tag": ["word"] * len(words), "region": [k[0] for k in words], "word": [k[1] for k in words], "n": list(words.values())}, len(words))
            yield emit({"tag": ["line"] * len(ends), "kind": [k[0] for k in ends], "head": [k[1] for k in ends], "final": [k[2] for k in ends], "n": list(ends.values())}, len(ends))
            words.clear()
            ends.clear()

        for batch in batches:
            id_type, source_type = batch.schema.field(0).type, batch.schema.field(2).type
            out: dict = {c: [] for c in names[1:-1]}
            keys, feeds = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            for k, text in enumerate(batch.column(1).to_pylist()):
                if not text or not text.strip():
                    continue
                f = read_text(text)
                for c in ("cut", "ends_line", "endings", "region", "fragment", "word", "kind", "head", "final"):
                    out[c].append(f[c])
                out["doc_id"].append(keys[k])
                out["source"].append(feeds[k])
                out["n_chars"].append(len(text))
                out["n_bytes"].append(len(text.encode("utf-8", "replace")))
                # the last line counts only where it surely is whole; of lines after diffs it is the only one
                whole = f["ends_line"] or f["last_state"] not in ("message", "hunk")
                inner = f["kinds"] if whole else f["kinds"][:-1]
                for region in ("message", "hunk"):
                    found = _WORDS.findall("\n".join(x for kind, x in inner if (kind in ("message", "title")) == (region == "message")).lower())
                    words.update(zip(repeat(region), found))
                ends.update((kind, _head(x), final_class(x)) for kind, x in inner if kind != "title")
            size = len(out["doc_id"])
            if size:
                yield emit({"tag": ["doc"] * size} | out, size)
            if len(words) > 200_000:
                yield from counts()
        if id_type is not None:
            yield from counts()

    return docs.mapInArrow(run, _FACTS.format(id=ids.simpleString(), source=sources.simpleString()))


def judge_texts(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(source, doc_id, reason): one row per input row with content; reason is null for texts that aren't cut.

    Null, empty and blank texts have no row. A null source is a source of its own. Repeated rows are judged
    each. All baselines are shares counted over the whole corpus: partial counts per batch, then one aggregation.
    """
    docs = pick(documents, doc_id=id_col, text=text_col, source=source_col)
    work = Workspace(documents.sparkSession, "truncation")
    facts = work.put("facts", _facts(docs).withColumn("row", F.monotonically_increasing_id()))
    doc = facts.where("tag = 'doc'").drop("tag", "n")
    small = lambda name, df: broadcast_if_small(work.put(name, df), MAX_BROADCAST_ROWS)

    # lengths at which a source cuts: in characters or in bytes, whichever explains more of its cut texts
    cuts = doc.groupBy(F.col("source").alias("_s")).agg(F.sum((F.col("cut") != "").cast("int")).alias("all_cut"))

    def lengths(unit: str) -> DataFrame:
        n = doc.groupBy("source", F.col(unit).alias("_limit")).agg(F.count("*").alias("n"), F.sum((F.col("cut") != "").cast("int")).alias("n_cut"))
        n = n.join(cuts, n["source"].eqNullSafe(cuts["_s"])).drop("_s")
        return n.where((F.col("n_cut") - 1 > LIMIT_OF_CUTS * F.col("all_cut")) & (F.col("n_cut") >= LIMIT_SHARE * F.col("n"))).withColumn("unit", F.lit(unit))

    both = lengths("n_chars").unionByName(lengths("n_bytes"))
    better = both.groupBy("source").agg(F.max_by("unit", F.col("n_cut")).alias("_unit"), F.max("n_cut")).select(F.col("source").alias("_s"), "_unit")
    limits = both.join(better, both["source"].eqNullSafe(better["_s"]) & (F.col("unit") == F.col("_unit"))).select(F.col("source").alias("_source"), "_unit", "_limit")
    # a text cut at a byte limit lacks up to three bytes more, those of the character that was cut
    limits = limits.withColumn("_length", F.explode(F.sequence(F.col("_limit") - F.when(F.col("_unit") == "n_bytes", 3).otherwise(0), F.col("_limit"))))
    limits = small("limits", limits.where((F.col("_unit") == "n_bytes") | (F.col("_length") == F.col("_limit"))))
    reached = F.when(F.col("_unit") == "n_bytes", F.col("n_bytes")).otherwise(F.col("n_chars")) == F.col("_length")
    reached &= (F.col("_length") == F.col("_limit")) | (F.col("n_chars") < F.col("n_bytes"))
    full = doc.join(limits, doc["source"].eqNullSafe(limits["_source"]) & reached, "left_semi").select("row", F.lit(True).alias("full"))
    # the ending that most texts of a source have
    seen = doc.groupBy("source", F.col("endings")[0].alias("ending")).agg(F.count("*").alias("n"))
    most = seen.groupBy("source").agg(F.max_by("ending", F.struct("n", "ending")).alias("terminator"), F.max("n").alias("n_end"), F.sum("n").alias("n_all"))
    signing = small("signing", most.where((F.col("terminator") != "") & (F.col("n_end") >= SIGNED_SHARE * F.col("n_all"))).select(F.col("source").alias("_source"), "terminator"))
    # how often words stand inside texts, and how lines of a kind end
    known = facts.where("tag = 'word'").groupBy("region", "word").agg(F.sum("n").alias("known"))
    # a word that was cut is rare beside the longer words that it begins
    prefixes = known.where(F.length("word") > 1).select("region", "known", F.explode(F.transform(F.sequence(F.lit(1), F.length("word") - 1), lambda i: F.substr("word", F.lit(1), i))).alias("word")).groupBy("region", "word").agg(F.sum("known").alias("begun"))
    ends = facts.where("tag = 'line'").groupBy("kind", "head", "final").agg(F.sum("n").alias("n_like"))
    like = ends.groupBy("kind", "head").agg(F.sum("n_like").alias("n_kind"))
    # an unfinished sentence of common words after finished ones; foreign words may be a quotation
    total = doc.agg((F.count("*") * COMMON_SHARE).alias("_least"))
    parts = doc.where(F.col("fragment").isNotNull()).select("row", F.explode("fragment").alias("word"))
    common = known.where("region = 'message'").select("word", "known")
    rarest = parts.join(common, "word", "left").groupBy("row").agg(F.min(F.coalesce("known", F.lit(0))).alias("_rarest"))
    prose = rarest.join(F.broadcast(total), F.col("_rarest") >= F.col("_least")).select("row", F.lit(True).alias("prose"))
    # texts without a last word or line of a kind take no part in the joins on these
    worded = doc.where(F.col("word").isNotNull()).select("row", "region", "word").join(known, ["region", "word"], "left").join(prefixes, ["region", "word"], "left").select("row", "known", "begun")
    lined = doc.where(F.col("kind").isNotNull()).select("row", "kind", "head", "final").join(like, ["kind", "head"], "left").join(ends, ["kind", "head", "final"], "left").select("row", "n_kind", "n_like")
    d = doc.select("row", "source", "doc_id", "cut", "ends_line", "endings", "region", "final")
    for flag in (full, prose, worded, lined):
        d = d.join(flag, "row", "left")
    d = d.join(signing, d["source"].eqNullSafe(signing["_source"]), "left").drop("_source")
    signed = F.coalesce(F.array_contains("endings", F.col("terminator")), F.lit(False))
    signed_last = F.coalesce(F.col("endings")[0] == F.col("terminator"), F.lit(False))
    closed = (F.col("region") == "after") & ~F.col("final").isin("a", "0") & (F.coalesce("n_like", F.lit(0)) >= CLOSED_SHARE * F.col("n_kind"))
    open_end = ~F.col("ends_line") & ~signed_last & ~F.coalesce(closed, F.lit(False))
    unlike = F.coalesce("n_like", F.lit(0)) + KIND_PRIOR <= KIND_SHARE * F.col("n_kind")
    reason = (
        F.when(F.col("cut") != "", F.col("cut"))
        .when(F.col("terminator").isNotNull() & ~signed, "terminator missing")
        .when(F.col("full") & open_end, "stops at the limit of its source")
        .when(open_end & (F.coalesce("known", F.lit(0)) <= WORD_SHARE * F.col("begun")), "stops inside a word")
        .when(open_end & unlike, "ends unlike its kind of line")
        .when(open_end & F.col("prose"), "stops inside a sentence")
    )
    return d.select("source", "doc_id", reason.alias("reason"))


def find_truncated(documents: DataFrame, **columns: str) -> DataFrame:
    """(source, doc_id) of the texts that stop before their content does, each pair once."""
    return judge_texts(documents, **columns).where(F.col("reason").isNotNull()).select("source", "doc_id").distinct()


def truncation_rates(documents: DataFrame, **columns: str) -> DataFrame:
    """Per source: rows with content, rows cut, and their share."""
    cut = F.sum(F.col("reason").isNotNull().cast("long"))
    return judge_texts(documents, **columns).groupBy("source").agg(F.count("*").alias("n_docs"), cut.alias("n_truncated"), (cut / F.count("*")).alias("share"))
