"""Chunks of source files as relations: lines with their lexical state, symbols, members, gaps between symbols, sections and windows.

Every file is read once into narrow rows, one for each line, that say what the line is (functions.lexing). One shuffle brings the lines of a
file together; all that follows are windows over it. Texts join again at the end, when chunks are cut out of them.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomwright.functions.lexing import BLANK, CODE, COMMENT, DECORATOR, HOLLOW, read_lines
from loomwright.functions.text import split_lines

MAX_LINES, OVERLAP, MIN_GAP = 120, 10, 3
_BLANK_LINE = r"^\s*$"

_ARGUMENTS = r"\((?:[^()]|\((?:[^()]|\([^()]*\))*\))*\)"
#: A function as a value.
_VALUE = rf"(?:async\s+)?(?:function\b|(?:<[^>]*>\s*)?{_ARGUMENTS}\s*(?::[^={{]+)?=>|[\w$]+\s*=>)"
#: Heads of statements that are symbols: language, kind, pattern (its groups: an owner or nothing, then the name), the name where there is none.
STARTS = [
    ("python", "function", r"^()(?:async\s+)?def\s+(\w+)", None),
    ("python", "class", r"^()class\s+(\w+)", None),
    ("go", "method", r"^func\s*\([^)]*?\*?(\w+)(?:\[[^\]]*\])?\s*\)\s*(\w+)", None),
    ("go", "function", r"^()func\s+(\w+)", None),
    ("go", "struct", r"^()type\s+(\w+)(?:\[[^\]]*\])?\s+struct\b", None),
    ("go", "interface", r"^()type\s+(\w+)(?:\[[^\]]*\])?\s+interface\b", None),
    ("go", "type", r"^()type\s+(\w+)", None),
    *[
        (language, kind, pattern, other)
        for language in ("javascript", "typescript")
        for kind, pattern, other in (
            ("function", r"^()(?:export\s+)?(?:default\s+)?(?:async\s+)?function\b\s*\*?\s*([\w$]+)", None),
            ("function", r"^()(export)\s+default\s+(?:async\s+)?function\b", "default"),
            ("function", rf"^()(export)\s+default\s+{_VALUE}", "default"),
            ("class", r"^()(?:export\s+)?(?:default\s+)?(?:abstract\s+)?class\s+(?!extends\b|implements\b)([\w$]+)", None),
            ("class", r"^()(export)\s+default\s+(?:abstract\s+)?class\b", "default"),
            ("interface", r"^()(?:export\s+)?(?:default\s+)?interface\s+([\w$]+)", None),
            ("enum", r"^()(?:export\s+)?(?:const\s+)?enum\s+([\w$]+)", None),
            ("namespace", r"^()(?:export\s+)?namespace\s+([\w$.]+)", None),
            ("type", r"^()(?:export\s+)?type\s+([\w$]+)[^=]*=", None),
            ("function", rf"^()(?:export\s+)?(?:const|let|var)\s+([\w$]+)\s*(?::(?:[^=]|=>)+?)?=\s*{_VALUE}", None),
            ("function", rf"^()([\w$.\[\]\"]{{1,80}})\s*=\s*{_VALUE}", None),
        )
    ],
]
#: Heads of declarations in a group, type ( ... ): kind, pattern.
SPECS = [("struct", r"^(\w+)(?:\[[^\]]*\])?\s+struct\b"), ("interface", r"^(\w+)(?:\[[^\]]*\])?\s+interface\b"), ("type", r"^(\w+)\b")]
GROUP = r"^type\s*\("
#: Heads of members of a class: language, pattern (its group: the name).
_MODIFIERS = r"(?:(?:public|private|protected|static|async|get|set|readonly|override|declare|accessor)\s+)*"
MEMBERS = [("python", r"^(?:async\s+)?def\s+(\w+)")] + [
    (language, pattern)
    for language in ("javascript", "typescript")
    for pattern in (
        rf"^{_MODIFIERS}\*?\s*(#?[\w$]+|\[[^\]]*\])\s*(?:<[^>]*>)?\s*{_ARGUMENTS}\s*(?::[^;]+?)?\{{",
        rf"^{_MODIFIERS}abstract\s+{_MODIFIERS}(#?[\w$]+)\s*(?:<[^>]*>)?\s*\(",
        rf"^{_MODIFIERS}(#?[\w$]+)[?!]?\s*(?::(?:[^=]|=>)+?)?=\s*{_VALUE}",
    )
]

STATE = "file string, language string, n int, role string, depth int, low int, indent int, head string"


def lines(files: DataFrame) -> DataFrame:
    """files (file, language, text) as (file, language, n, line), n from 1; a file without text has none."""
    out = files.select("file", "language", F.posexplode(split_lines(F.coalesce("text", F.lit("")))).alias("n", "line"))
    return out.withColumn("n", F.col("n") + 1)


def states(files: DataFrame) -> DataFrame:
    """files (file, language, text) as (file, language, n, role, depth, low, indent, head): what each line is, where it stands, and
    the head of the statement that begins in it. Markdown: the level and title of a heading as depth and head."""
    kind = files.schema["file"].dataType
    schema = T.StructType([T.StructField("file", kind), *T._parse_datatype_string(STATE).fields[1:]])

    def read(batches: Iterator) -> Iterator:
        import pyarrow as pa

        kinds = [None, *(pa.string() if c in ("language", "role", "head") else pa.int32() for c in schema.names[1:])]
        for batch in batches:
            kinds[0] = batch.schema.field(0).type
            rows: list[tuple] = []
            for file, language, text in zip(*(batch.column(k) for k in range(3)), strict=True):
                file, language = file.as_py(), language.as_py()
                rows += [(file, language, n, *line) for n, line in enumerate(read_lines(language, text.as_py()), 1)]
                if len(rows) >= 50_000:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=schema.names)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=schema.names)

    # A line of any length tells its state, but a head holds a part of it.
    return files.select("file", "language", split_lines(F.coalesce("text", F.lit(""))).alias("lines")).mapInArrow(read, schema)


def _named(outside: str) -> Column:
    """struct(kind, symbol) of the head of a statement where outside holds, or null; as one expression of SQL, since each column object is a call of its own."""
    cases = []
    for language, kind, pattern, other in STARTS:
        owner, name = (f"regexp_extract(head, r'{pattern}', {k})" for k in (1, 2))
        symbol = f"'{other}'" if other else name if "^()" in pattern else f"concat_ws('.', {owner}, {name})"
        cases.append(f"WHEN language = '{language}' AND head RLIKE r'{pattern}' THEN named_struct('kind', '{kind}', 'symbol', {symbol})")
    return F.expr(f"CASE WHEN head IS NULL OR NOT ({outside}) THEN NULL {' '.join(cases)} END")


def symbols(of: DataFrame, max_lines: int = MAX_LINES) -> DataFrame:
    """states() with ``pieces``, the symbols that are told from each line: an array of struct(symbol, kind, start, end).

    A symbol is a statement outside all brackets (in Python at the margin), with the comments and decorators right above it, to the
    last line of code before the next such statement. A class of over max_lines lines with members is what stands before the first member, and each
    of these; members are statements one level further in. Declarations in a Go group of several are symbols of their own.
    """
    n, python = F.col("n"), F.col("language") == "python"
    first, outside = F.col("head").isNotNull(), (F.col("depth") == 0) & (~python | (F.col("indent") == 0))
    lines_of = Window.partitionBy("file").orderBy("n")
    by_file = lines_of.rowsBetween(Window.unboundedPreceding, 0)
    above = lines_of.rowsBetween(Window.unboundedPreceding, -1)
    attached = F.col("role").isin(COMMENT, HOLLOW, DECORATOR)
    # In Python a comment that is not at the margin belongs to the block before it.
    solid = (F.col("role") == CODE) | (python & (F.col("role") == COMMENT) & (F.col("indent") > 0))
    starts_here = (first | ((F.col("role") == DECORATOR) & (F.lag("role", 1, "").over(lines_of) != DECORATOR))) & outside
    rows = of.withColumns({
        "top": starts_here,
        "solid": F.when(solid, n),
        "bare": F.coalesce(F.max(F.when(~attached | (python & (F.col("indent") > 0) & (F.col("role") == COMMENT)), n)).over(above), F.lit(0)),
        "named": _named("depth = 0 AND (language <> 'python' OR indent = 0)"),
    })
    rows = rows.withColumn("stmt", F.count(F.when(F.col("top"), n)).over(by_file))
    whole = Window.partitionBy("file", "stmt")
    in_order = whole.orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    # The statement's own line, which may stand below decorators told apart from it.
    rows = rows.withColumns({"owner": F.first("named").over(in_order), "from": F.first("n").over(in_order), "to": F.max("solid").over(whole), "is_group": F.first(F.coalesce((F.col("language") == "go") & F.col("head").rlike(GROUP), F.lit(False))).over(in_order), "begin": F.first("bare").over(in_order) + 1})
    long_ = (F.col("owner.kind") == "class") & (F.col("to") - F.col("begin") + 1 > max_lines)
    inside = n > F.col("from")
    margin = F.min(F.when(python & first & inside & (F.col("depth") == 0), F.col("indent"))).over(whole)
    rows = rows.withColumns({"long": long_, "margin": margin})
    next_in = F.when(python, (F.col("depth") == 0) & (F.col("indent") <= F.col("margin")) & (first | (F.col("role") == DECORATOR))).otherwise(((F.col("depth") == 1) & (first | (F.col("role") == DECORATOR))) | (F.col("low") < 1))
    # Strings and brackets may hold lines of lesser indent; these begin nothing.
    member = F.expr("CASE " + " ".join(f"WHEN language = '{language}' AND head RLIKE r'{pattern}' THEN regexp_extract(head, r'{pattern}', 1)" for language, pattern in MEMBERS) + " END")
    spec = F.expr("CASE " + " ".join(f"WHEN head RLIKE r'{pattern}' THEN named_struct('kind', '{kind}', 'symbol', regexp_extract(head, r'{pattern}', 1))" for kind, pattern in SPECS) + " END")
    level = F.when(python, (F.col("depth") == 0) & (F.col("indent") == F.col("margin"))).otherwise(F.col("depth") == 1)
    told = F.when(F.col("long"), F.when(member.isNotNull(), F.struct(F.lit("method").alias("kind"), F.concat_ws(".", "owner.symbol", member).alias("symbol")))).when(F.col("is_group"), spec)
    rows = rows.withColumns({
        "told": F.when(first & inside & level, told),
        "part": F.count(F.when(inside & next_in, n)).over(in_order),
        # Comments of a class's body stand at its margin in Python.
        "bare_in": F.max(F.when(~F.coalesce(attached & (~python | (F.col("role") == DECORATOR) | (F.col("indent") == F.col("margin"))), F.lit(False)), n)).over(whole.orderBy("n").rowsBetween(Window.unboundedPreceding, -1)),
    })
    # A comment at the margin of a Python class belongs to what follows.
    within = F.when(~python | (F.col("role") == CODE) | (F.col("indent") > F.col("margin")), F.col("solid"))
    rows = rows.withColumns({"part_to": F.max(within).over(Window.partitionBy("file", "stmt", "part")), "n_told": F.count("told").over(whole)})
    rows = rows.withColumn("first_told", F.min(F.when(F.col("told").isNotNull(), F.col("bare_in") + 1)).over(whole))
    rows = rows.withColumn("head_to", F.max(F.when(~F.col("role").isin(BLANK, HOLLOW) & (n < F.col("first_told")), n)).over(whole))
    piece = lambda what, start, end: F.struct(what["symbol"].alias("symbol"), what["kind"].alias("kind"), start.cast("int").alias("start"), end.cast("int").alias("end"))
    grouped = F.col("is_group") & (F.col("n_told") > 0)
    own = F.when((n == F.col("from")) & F.col("owner").isNotNull(), piece(F.col("owner"), F.col("begin"), F.when(F.col("long") & (F.col("n_told") > 0), F.col("head_to")).otherwise(F.col("to"))))
    # A group of one is its declaration, whole.
    single = F.col("is_group") & (F.col("n_told") == 1)
    inner = F.when(F.col("told").isNotNull(), piece(F.col("told"), F.when(single, F.col("begin")).otherwise(F.col("bare_in") + 1), F.when(single, F.col("to")).otherwise(F.col("part_to"))))
    pieces = F.array_compact(F.array(F.when(~grouped, own), inner))
    return rows.select("file", "language", "n", "role", pieces.alias("pieces"))


def _with_gaps(found: DataFrame, min_solid: int) -> DataFrame:
    """symbols() with the gaps between them as further pieces: runs of lines in none, blank ends cut off, with min_solid lines or more that are not blank; one is enough in a file
    without symbols. A gap is told from its first line."""
    by_file = Window.partitionBy("file").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    # Backwards, since a frame that ends with the file is computed anew for each row.
    upwards = Window.partitionBy("file").orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, -1)
    # No two symbols share a line, so one that ends at n or later begins before, or is told from n or above; or else from below.
    last = F.max(F.array_max(F.transform("pieces", lambda p: p["end"]))).over(by_file)
    below = F.min(F.array_min(F.transform("pieces", lambda p: p["start"]))).over(upwards)
    covered = (F.coalesce(last, F.lit(0)) >= F.col("n")) | F.coalesce(below <= F.col("n"), F.lit(False))
    rows = found.withColumn("covered", covered).withColumn("run", F.count(F.when(F.col("covered"), F.lit(1))).over(by_file))
    # A run is what stands below the line that is counted last; that one itself is not in it.
    run = Window.partitionBy("file", "run")
    free = F.when(~F.col("covered") & ~F.col("role").isin(BLANK, HOLLOW), F.col("n"))
    some = F.max(F.size("pieces")).over(Window.partitionBy("file")) > 0
    rows = rows.withColumns({"free": free, "some": some})
    rows = rows.withColumns({"start": F.min("free").over(run), "end": F.max("free").over(run), "n_free": F.count("free").over(run)})
    gap = F.struct(F.lit(None).cast("string").alias("symbol"), F.lit("window").alias("kind"), "start", "end")
    enough = (F.col("n") == F.col("start")) & ~F.col("covered") & (F.col("n_free") >= F.when(F.col("some"), min_solid).otherwise(1))
    return rows.select("file", F.concat("pieces", F.when(enough, F.array(gap)).otherwise(F.array().cast("array<struct<symbol:string,kind:string,start:int,end:int>>"))).alias("pieces"))


def gaps(of: DataFrame, covered: DataFrame, min_solid: int = MIN_GAP) -> DataFrame:
    """(file, start, end): runs of lines outside the spans covered, blank ends cut off, with min_solid lines or more that are not blank; one is enough in a file without spans."""
    taken = covered.select("file", F.explode(F.sequence("start", "end")).alias("n")).distinct()
    free = of.join(taken, ["file", "n"], "left_anti")
    run = F.col("n") - F.row_number().over(Window.partitionBy("file").orderBy("n"))
    free = free.withColumn("run", run).filter(~F.col("line").rlike(_BLANK_LINE))
    found = free.groupBy("file", "run").agg(F.min("n").alias("start"), F.max("n").alias("end"), F.count("*").alias("solid"))
    some = covered.select("file").distinct().withColumn("some", F.lit(True))
    met = found.join(some, "file", "left").filter(F.col("solid") >= F.when(F.col("some"), min_solid).otherwise(1))
    return met.select("file", "start", "end")


def sections(of: DataFrame) -> DataFrame:
    """states() of Markdown as (file, pieces): what stands before the first heading, then each heading with a body; symbol is the path of headings."""
    by_file = Window.partitionBy("file").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    level, title = F.when(F.col("head").isNotNull(), F.col("depth")), F.col("head")
    rows = of.withColumns({"level": level, "section": F.count("head").over(by_file)})
    # Above a heading stands, of each lesser level, the last heading, unless one of a still lesser level came after it.
    last = lambda k: F.last(F.when(F.col("level") == k, F.struct("section", title.alias("title"))), ignorenulls=True).over(by_file)
    rows = rows.withColumns({f"h{k}": last(k) for k in range(1, 6)})
    after = lambda k: F.col(f"h{k}.section") > F.greatest(F.lit(0), F.lit(0), *[F.coalesce(F.col(f"h{j}.section"), F.lit(0)) for j in range(1, k)])
    above = F.array(*[F.when((F.col("level") > k) & after(k), F.col(f"h{k}.title")) for k in range(1, 6)])
    path = F.when(F.col("level").isNotNull(), F.array_join(F.array_append(F.array_compact(above), title), " > "))
    rows = rows.filter(F.col("role") != BLANK).withColumn("symbol", path)
    bodies = rows.groupBy("file", "section").agg(F.max("symbol").alias("symbol"), F.min("n").alias("start"), F.max("n").alias("end"), F.count("*").alias("solid"))
    bodies = bodies.filter((F.col("section") == 0) | (F.col("solid") > 1))
    return bodies.select("file", F.array(F.struct("symbol", F.lit("doc").alias("kind"), "start", "end")).alias("pieces"))


def windows(start: Column, end: Column, max_lines: int, overlap: int) -> Column:
    """Array of struct(s, e): windows of max_lines over [start, end], each begins overlap lines before the last one ends."""
    if not 0 <= overlap < max_lines:
        raise ValueError("need 0 <= overlap < max_lines")
    step = max_lines - overlap
    last = F.greatest(F.ceil((end - start + 1 - max_lines) / step), F.lit(0))
    return F.transform(F.sequence(F.lit(0).cast("long"), last.cast("long")), lambda i: F.struct((start + i * step).cast("int").alias("s"), F.least(end, start + i * step + max_lines - 1).cast("int").alias("e")))


def split_oversized(pieces: Column, all_lines: Column, max_lines: int = MAX_LINES, overlap: int = OVERLAP) -> Column:
    """The array pieces as an array of struct(symbol, kind, start, end, part, parts, content): longer ones as windows, those of blank lines alone dropped."""
    content = lambda w: F.array_join(F.slice(all_lines, w["s"], w["e"] - w["s"] + 1), "\n")
    cut = lambda p: F.filter(F.transform(windows(p["start"], p["end"], max_lines, overlap), lambda w: F.struct(w["s"].alias("start"), w["e"].alias("end"), content(w).alias("content"))), lambda w: w["content"].rlike(r"\S"))
    part = lambda p, all_, w, i: F.struct(p["symbol"].alias("symbol"), p["kind"].alias("kind"), w["start"].alias("start"), w["end"].alias("end"), (i + 1).alias("part"), F.size(all_).alias("parts"), w["content"].alias("content"))
    whole = lambda p: F.element_at(F.transform(F.array(cut(p)), lambda all_: F.transform(all_, lambda w, i: part(p, all_, w, i))), 1)
    return F.flatten(F.transform(pieces, whole))


def build(pieces: DataFrame, files: DataFrame, max_lines: int = MAX_LINES, overlap: int = OVERLAP) -> DataFrame:
    """Chunks of pieces (file, pieces): content is exactly the lines, embed_text has a header before them. Each file's lines are split once for all its pieces."""
    wanted = pieces.filter(F.size("pieces") > 0).groupBy("file").agg(F.flatten(F.collect_list("pieces")).alias("pieces"))
    met = files.select("file", "language", split_lines(F.coalesce("text", F.lit(""))).alias("all")).join(wanted, "file")
    met = met.select("file", "language", F.inline(split_oversized(F.col("pieces"), F.col("all"), max_lines, overlap)))
    # The header is part of what is hashed.
    part = F.when(F.col("parts") > 1, F.format_string("Part: %d/%d", "part", "parts"))
    header = F.concat_ws("\n", F.concat(F.lit("File: "), "file"), F.concat(F.lit("Language: "), "language"), F.concat(F.lit("Symbol: "), F.coalesce("symbol", F.lit("(none)"))), F.concat(F.lit("Kind: "), "kind"), part)
    out = met.select("file", "language", "symbol", "kind", "start", "end", "content", header.alias("header"))
    return out.withColumn("embed_text", F.concat("header", F.lit("\n---\n"), "content")).withColumn("text_hash", F.sha2("embed_text", 256)).drop("header")


def report(made: DataFrame) -> DataFrame:
    """(language, kind, chunks, files, longest) of chunks."""
    return made.groupBy("language", "kind").agg(F.count("*").alias("chunks"), F.countDistinct("file").alias("files"), F.max(F.length("content")).cast("long").alias("longest"))


def in_order(made: DataFrame) -> DataFrame:
    """Chunks by file, then start, end and symbol."""
    return made.orderBy("file", "start", "end", F.coalesce("symbol", F.lit("")))


def chunk(files: DataFrame, max_lines: int = MAX_LINES, overlap: int = OVERLAP, min_gap: int = MIN_GAP) -> DataFrame:
    """All chunks of files (file, language, text); file is a key."""
    if not 0 <= overlap < max_lines:
        raise ValueError("need 0 <= overlap < max_lines")
    # A language without a name is no Markdown; its files are cut into windows.
    markdown = F.coalesce(F.col("language") == "markdown", F.lit(False))
    code = _with_gaps(symbols(states(files.filter(~markdown)), max_lines), min_gap)
    return build(code.unionByName(sections(states(files.filter(markdown)))), files, max_lines, overlap)
