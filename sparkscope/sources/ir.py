"""Compiler IR text as tables: functions, calls, pointer flows, field addresses and dispatch tables."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkscope.functions import ctext
from sparkscope.functions.names import split_top_level
from sparkscope.operators.segmented import SEGMENT, Lines, run_segments, segments_of
from sparkscope.session import materialise, workers_see_package

# The line patterns of the IR dialect that is read.
DEFINE = r"^define\s+.*?@([a-zA-Z_][a-zA-Z0-9_]*)\s*\("
DECLARE = r"^declare\s+.*?@([a-zA-Z_][a-zA-Z0-9_]*)\s*\("
DIRECT_CALL = r"(?:call|invoke)\s+[^@]*@([a-zA-Z_][a-zA-Z0-9_]*)\s*\(([^)]*)\)"
INDIRECT_CALL = r"(?:call|invoke)\s+[^@]*?%([a-zA-Z0-9_.]+)\s*\("
STORE_FUNCTION = r"store\s+.*?@([a-zA-Z_][a-zA-Z0-9_]*)\s*,.*%([a-zA-Z0-9_.]+)"
STORE_POINTER = r"store\s+[^%]*%([a-zA-Z0-9_.]+)\s*,\s*[^%]*%([a-zA-Z0-9_.]+)"
LOAD = r"%([a-zA-Z0-9_.]+)\s*=\s*load\s+.*[%@]([a-zA-Z0-9_.]+)"
LOAD_GLOBAL = r"%([a-zA-Z0-9_.]+)\s*=\s*load\s+.*?@([a-zA-Z_][a-zA-Z0-9_.]*)"
FIELD_ADDRESS = (
    r"%([a-zA-Z0-9_.]+)\s*=\s*getelementptr\s+(?:inbounds\s+)?(%(?:struct|class|union)\.[a-zA-Z0-9_.]+)\s*,"
    r"\s*[^,]*%([a-zA-Z0-9_.]+)\s*,.*?(?:i32|i64)\s+0\s*,\s*(?:i32|i64)\s+(\d+)"
)
SLOT_ADDRESS = r"%([a-zA-Z0-9_.]+)\s*=\s*getelementptr\s+(?:inbounds\s+)?(?:ptr|[^,]+\*+)\s*,\s*(?:ptr|[^,]+\*+)\s+%([a-zA-Z0-9_.]+)\s*,\s*(?:i32|i64)\s+(\d+)\s*$"
DISPATCH_TABLE = r"^@(_ZTV[a-zA-Z0-9_]+)\s*=.*?(?:constant|global)\s+.*?\{.*?\[.*?\]\s*\[([^\]]+)\]"
TABLE_START = "@_ZTV"
# Parameter attributes that are neither type nor name, and those that end a parameter.
ATTRIBUTES = (
    "nocapture", "readonly", "writeonly", "noundef", "nonnull", "inreg", "zeroext", "signext", "byval", "sret", "noalias", "nocallback", "nounwind",
    "willreturn", "memory", "argmemonly",
)
ENDING_ATTRIBUTES = ("align", "dereferenceable", "dereferenceable_or_null")


@dataclass(frozen=True)
class ProgramFacts:
    """Tables read from IR lines; ``ord`` orders rows as the text does."""

    functions: DataFrame  # name, defined, file, line, params array<struct<type,name>>, first_seen struct<file,line_no>
    call_sites: DataFrame  # caller, callee, args array<string>, ord
    indirect_calls: DataFrame  # caller, ptr, file, line
    flows: DataFrame  # owner, dst, src, ord, kind
    fields: DataFrame  # owner, dst, struct_type, field_idx, base, ord
    table_entries: DataFrame  # vtable, slot, fn
    table_slots: DataFrame  # owner, dst, base, slot
    global_loads: DataFrame  # owner, dst, src, ord


def read_ir_lines(spark: SparkSession, root: str) -> DataFrame:
    """(file, line_no, text) of all ``.ll`` files below a folder, however large; files are read in splits.

    Lines are numbered by their place in their split, after the lines of the
    splits before it, which a table with a row per split counts.
    """
    read = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.ll").option("lineSep", "\n").text(root)
    lines = read.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("id"), F.col("value").alias("text"))
    sizes = lines.groupBy(F.col("file").alias("f"), F.col("split").alias("s")).agg(F.min("id").alias("first"), F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("f").orderBy("s").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select("f", "s", (F.coalesce(before, F.lit(0)) - F.col("first") + 1).alias("shift"))
    joined = lines.join(starts, (F.col("file") == F.col("f")) & (F.col("split") == F.col("s")))
    return joined.select("file", (F.col("id") + F.col("shift")).cast("int").alias("line_no"), "text")


def lines_of(files: DataFrame) -> DataFrame:
    """(file, line_no, text) from (file, text)."""
    return files.select("file", F.posexplode(F.split("text", "\n")).alias("line_no", "text")).withColumn("line_no", F.col("line_no") + 1)


class SignatureMachine:
    """Reads IR lines in order: signatures over several lines are put on their first one, and each line gets the definition it stands in.

    A definition is read up to ``{``, a declaration up to ``)`` before any
    comment; lines on the way belong to it whatever they hold. Its states are
    four: outside a signature, in a definition's, in a declaration's, and in a
    declaration's after a comment began, which nothing ends.
    """

    OUTSIDE, DEFINING, DECLARING, COMMENTED = range(4)
    schema = "line_no long, head long, text string, fn string, defined boolean, owner string, open boolean"
    start = (OUTSIDE, None, None)

    def __init__(self) -> None:
        self.define, self.declare = (re.compile(p, re.ASCII) for p in (DEFINE, DECLARE))

    def _inside(self, mode: int, text: str) -> int:
        """The state after a line of a signature."""
        if mode == self.DEFINING:
            return self.OUTSIDE if "{" in text else mode
        if mode == self.COMMENTED:
            return mode
        before, comment, _ = text.partition("//")
        return self.OUTSIDE if ")" in before else self.COMMENTED if comment else mode

    def _outside(self, text: str) -> tuple[int, str | None, bool | None]:
        """(state, function, whether it is defined) after a line outside of signatures."""
        if text.startswith("define") and (found := self.define.match(text)):
            return self._inside(self.DEFINING, text), found[1], True
        if text.startswith("declare") and (found := self.declare.match(text)):
            whole = text.rstrip().endswith(")")
            return self.OUTSIDE if whole else self._inside(self.DECLARING, text), found[1], False
        return self.OUTSIDE, None, None

    def summary(self, lines: Lines) -> tuple:
        """For each state before: (state after, first line of its signature or None for the one before, (whether the owner changes, owner))."""
        plain: list[tuple[int, int]] = []  # after each line of the run from outside: its state, and the last line that changed the owner
        end = self._run(self.OUTSIDE, lines, plain, ())
        # nothing ends a declaration after its comment began
        return (end, *(self._run(mode, lines, [], plain, end) for mode in (self.DEFINING, self.DECLARING)), (self.COMMENTED, None, (False, None)))

    def _run(self, mode: int, lines: Lines, trace: list[tuple[int, int]], plain: list[tuple[int, int]], end: tuple = ()) -> tuple:
        head, owner, changed = None, (False, None), -1
        for i, (line_no, text) in enumerate(lines):
            if mode:
                mode = self._inside(mode, text)
                if plain and not mode and not plain[i][0]:
                    # from here on this run is the plain one; the owner is that run's if it changes later on
                    return (end[0], end[1], end[2] if plain[-1][1] > i else owner)
            elif text.startswith("de"):
                mode, fn, defined = self._outside(text)
                head = line_no if mode else head
                if defined:
                    owner, changed = (True, fn), i
            elif "}" in text and text.strip() == "}":
                owner, changed = (True, None), i
            trace.append((mode, changed))
        return mode, head, owner

    def compose(self, first: tuple, second: tuple) -> tuple:
        out = []
        for mode, head, owner in first:
            mode, later, last = second[mode]
            out.append((mode, head if later is None else later, last if last[0] else owner))
        return tuple(out)

    def after(self, state: tuple, summary: tuple) -> tuple:
        mode, head, owner = summary[state[0]]
        return mode, state[1] if head is None else head, owner[1] if owner[0] else state[2]

    def rows(self, state: tuple, lines: Lines) -> Iterator[tuple]:
        """A row for each line outside of signatures and for each signature, or for the part of it that is in these lines (``open``)."""
        mode, head, owner = state
        first, pieces, said = (lines[0][0] if lines else None), [], (None, None)
        started = not mode
        for line_no, text in lines:
            if mode:
                pieces.append(text.strip())
                mode = self._inside(mode, text)
                if not mode:
                    yield first, head, " ".join(pieces), *said, owner, not started
                    pieces = []
                continue
            mode, fn, defined = self._outside(text)
            if defined:
                owner = fn
            elif text.strip() == "}":
                owner = None
            if mode:
                head = first = line_no
                pieces, said, started = [text], (fn, defined), True
            else:
                yield line_no, line_no, text, fn, defined, owner, False
        if mode and pieces:
            yield first, head, " ".join(pieces), *said, owner, True


def signature_rows(lines: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """(file, line_no, text, fn, defined, owner): lines with signatures joined on their first line.

    Files are read in segments, however long they are. Only signatures that
    cross a segment's end are gathered by their first line; one that is never
    closed takes the rest of its file, as it does for a reader in order.
    """
    return _uncut(materialise(run_segments(materialise(segments_of(lines, segment)), SignatureMachine())))


def _uncut(rows: DataFrame) -> DataFrame:
    """Rows of the machine with the parts of a signature joined."""
    part = F.struct("line_no", "text", "fn", "defined", "owner")
    parts = rows.where("open").groupBy("file", "head").agg(F.array_sort(F.collect_list(part)).alias("p"))
    first = F.element_at("p", 1)
    crossed = parts.select("file", F.col("head").alias("line_no"), F.array_join(F.transform("p", lambda x: x["text"]), " ").alias("text"), *(first[c].alias(c) for c in ("fn", "defined", "owner")))
    return rows.where("not open").select("file", F.col("head").alias("line_no"), "text", "fn", "defined", "owner").unionByName(crossed)


_BRACKETS, _BLANKS, _NAMED_TYPE = re.compile("[()]"), re.compile(r"\s+", re.ASCII), re.compile(r'%(struct\.|union\.|class\.|")')
_PARAMETERS = pa.list_(pa.struct([("type", pa.string()), ("name", pa.string())]))


def balanced(text: str) -> str:
    """What stands between the first ``(`` and its closer (or the end)."""
    start, depth = text.find("("), 0
    for m in _BRACKETS.finditer(text, max(start, 0)):
        depth += 1 if m[0] == "(" else -1
        if not depth:
            return text[start + 1 : m.start()]
    return "" if start < 0 else text[start + 1 :]


def parameters_of(text: str) -> list[dict[str, str]]:
    """Type and name of each parameter in IR text; one without a register is named by its place among those kept."""
    kept: list[dict[str, str]] = []
    for part in ctext.split_top_level(text, " "):
        types, name = [], None
        for token in _BLANKS.split(part):
            register = token.startswith("%")
            if not token or token in ATTRIBUTES or ("(" in token and not register):
                continue
            if token in ENDING_ATTRIBUTES or (register and not _NAMED_TYPE.match(token)):
                name = token[1:] if register else None
                break
            types.append(token)
        if types and part != "..." and not part.startswith("metadata"):
            kept.append({"type": " ".join(types), "name": f"param_{len(kept)}" if name is None else name})
    return kept


def parameters(text: Column) -> Column:
    """(type, name) of each parameter of a signature."""

    @F.arrow_udf("array<struct<type:string,name:string>>")
    def read(values: pa.Array) -> pa.Array:
        return pa.array([parameters_of(balanced(v)) for v in values.to_pylist()], _PARAMETERS)

    return read(text)


#: Patterns of instructions: the words of which a line has one, and the groups that are kept.
INSTRUCTIONS = {
    DIRECT_CALL: (("call", "invoke"), ("callee", "args")), INDIRECT_CALL: (("call", "invoke"), ("ptr",)), STORE_FUNCTION: (("store",), ("src", "dst")), STORE_POINTER: (("store",), ("src", "dst")),
    LOAD: (("load",), ("dst", "src")), FIELD_ADDRESS: (("getelementptr",), ("dst", "struct_type", "base", "field_idx")), SLOT_ADDRESS: (("getelementptr",), ("dst", "base", "slot")), LOAD_GLOBAL: (("load",), ("dst", "src")),
}


class FactMachine(SignatureMachine):
    """Signatures as they are, and of the lines in bodies those that a pattern matches: for each pattern the groups of its matches, one after another.

    Lines that begin as dispatch tables do, wherever they stand, have a further
    row, with their text and no function. ``rare`` is true in these and where a
    pattern other than the first matches, and null elsewhere, so that tables of
    those need not read files without them.
    """

    def __init__(self, patterns: tuple[str, ...] = tuple(INSTRUCTIONS)) -> None:
        super().__init__()
        # in Spark's patterns a dot matches no line end of any kind
        found = [(INSTRUCTIONS[p][0], i, re.compile(p.replace(".*", "[^\n\r\x85\u2028\u2029]*"), re.ASCII).findall) for i, p in enumerate(patterns)]
        #: patterns by the words of which their lines have one
        self.patterns = [(words, [(i, f) for w, i, f in found if w == words]) for words in dict.fromkeys(w for w, _, _ in found)]
        self.n = len(patterns)
        self.schema = ", ".join([SignatureMachine.schema, "rare boolean", *(f"m{i} array<string>" for i in range(self.n))])

    def columns(self, state: tuple, lines: Lines) -> list[list | None]:
        """The rows by columns; a column of nulls is None. Lines are told apart as in ``SignatureMachine.rows``."""
        mode, head, owner = state
        first, pieces, said = (lines[0][0] if lines else None), [], (None, None)
        started = not mode
        at: list[int] = []  # lines, and their owners
        owners: list[str | None] = []
        signed: dict[int, tuple] = {}  # rows of signatures: head, text, function, whether it is defined, whether it is cut
        matched: list[dict[int, list[str]]] = [{} for _ in range(self.n)]
        rare: set[int] = set()
        for line_no, text in lines:
            if self.n and text.startswith(TABLE_START):
                rare.add(len(at))
                signed[len(at)] = (line_no, text, None, None, False)
                at.append(line_no)
                owners.append(None)
            if mode:
                pieces.append(text.strip())
                mode = self._inside(mode, text)
                if not mode:
                    # one of a part begun before has no function here
                    signed[len(at)] = (head, " ".join(pieces), *said, not started)
                    at.append(first)
                    owners.append(owner)
                    pieces = []
                continue
            if text.startswith("de"):
                mode, fn, defined = self._outside(text)
                if defined:
                    owner = fn
                if mode:
                    head = first = line_no
                    pieces, said, started = [text], (fn, defined), True
                    continue
                if fn is not None:
                    signed[len(at)] = (line_no, text, fn, defined, False)
                    at.append(line_no)
                    owners.append(owner)
                    continue
            elif "}" in text and text.strip() == "}":
                owner = None
            if owner is None:
                continue
            row, some = len(at), False
            for words, patterns in self.patterns:
                for w in words:
                    if w in text:
                        break
                else:
                    continue
                for i, find in patterns:
                    if m := find(text):
                        matched[i][row] = [g for x in m for g in ((x,) if isinstance(x, str) else x)]
                        some = True
                        if i:
                            rare.add(row)
            if some:
                at.append(line_no)
                owners.append(owner)
        if mode and pieces:
            signed[len(at)] = (head, " ".join(pieces), *said, True)
            at.append(first)
            owners.append(owner)
        heads, rest = at.copy(), [[None] * len(at) for _ in range(3)]
        cut = [False] * len(at)
        for row, (heads[row], *told, cut[row]) in signed.items():
            for column, value in zip(rest, told, strict=True):
                column[row] = value
        flags = [row in rare or None for row in range(len(at))] if rare else None
        return [at, heads, *(rest if signed else [None] * 3), owners, cut, flags, *([m.get(row) for row in range(len(at))] if m else None for m in matched)]

    def rows(self, state: tuple, lines: Lines) -> Iterator[tuple]:
        columns = self.columns(state, lines)
        return zip(*(c if c is not None else [None] * len(columns[0]) for c in columns), strict=True)


def read_functions(segments: DataFrame) -> DataFrame:
    """The functions of IR files alone (see :class:`ProgramFacts`), from segments of their lines; nothing else is written."""
    return _functions(materialise(run_segments(segments, FactMachine(()))))


def _functions(rows: DataFrame, with_parameters: bool = True) -> DataFrame:
    """Functions from the machine's rows, of which only signatures are read; written with their parameters, or else with the text that these are read of when asked for."""
    workers_see_package(rows.sparkSession)
    signatures = _uncut(rows.where("fn is not null or open")).where("fn is not null")
    signatures = signatures.select(F.col("fn").alias("name"), "defined", "file", F.col("line_no").cast("int").alias("line"), "text").withColumn("at", F.struct("file", F.col("line").alias("line_no")))
    # the last definition counts, else the first declaration; parameters are read of that one alone, as many files declare the same
    seen = signatures.groupBy("name").agg(
        F.max_by(F.struct("defined", "file", "line", "text"), F.when(F.col("defined"), F.col("at"))).alias("d"),
        F.min_by(F.struct("defined", "file", "line", "text"), "at").alias("f"),
        F.min("at").alias("first_seen"),
    )
    chosen = seen.select("name", F.coalesce("d", "f").alias("x"), "first_seen").select("name", "x.*", "first_seen")
    read = lambda df: df.select("name", "defined", "file", "line", parameters(F.col("text")).alias("params"), "first_seen")
    return materialise(read(chosen)) if with_parameters else read(materialise(chosen))


def parse_ir(lines: DataFrame) -> ProgramFacts:
    """All tables of IR lines (file, line_no, text). Order is (file, line_no, place in the line)."""
    return parse_segments(materialise(segments_of(lines)))


def parse_segments(segments: DataFrame, with_parameters: bool = True) -> ProgramFacts:
    """All tables of IR files in segments, which are read more than once.

    A line is matched in the pass that reads it: written are signatures, and
    what patterns found in bodies. Functions are written with their parameters,
    as several tables are joined with them, but for callers that ask for none.
    Tables of other patterns than direct calls skip row groups without any.
    """
    rows = materialise(run_segments(segments, FactMachine()))
    functions = _functions(rows, with_parameters)
    matched = rows.where("fn is null and not open").select("owner", "file", F.col("head").cast("int").alias("line_no"), "rare", *(c for c in rows.columns if c.startswith("m")))
    named = {p: f"m{i}" for i, p in enumerate(INSTRUCTIONS)}

    def found(pattern: str) -> DataFrame:
        groups, m = INSTRUCTIONS[pattern][1], F.col(named[pattern])
        matches = F.transform(F.sequence(F.lit(0), F.size(m) - len(groups), F.lit(len(groups))), lambda i: F.struct(*(F.get(m, i + j).alias(g) for j, g in enumerate(groups))))
        some = matched if pattern == DIRECT_CALL else matched.where("rare is not null")
        rows_ = some.where(m.isNotNull()).select("owner", "file", "line_no", F.posexplode(matches).alias("i", "m"))
        return rows_.select("owner", "file", "line_no", F.struct("file", "line_no", "i").alias("ord"), "m.*")

    calls = found(DIRECT_CALL).where(~F.col("callee").startswith("llvm."))
    call_sites = calls.select(F.col("owner").alias("caller"), "callee", split_top_level(F.col("args")).alias("args"), "ord")
    indirect = found(INDIRECT_CALL).select(F.col("owner").alias("caller"), "ptr", "file", F.col("line_no").alias("line"))

    def flow(pattern: str, kind: str) -> DataFrame:
        return found(pattern).select("owner", "dst", "src", "ord", F.lit(kind).alias("kind"))

    stores = flow(STORE_FUNCTION, "store_fn").where(~F.col("src").startswith("llvm."))
    typed = r"^(struct|class|union)\."
    pointers = flow(STORE_POINTER, "store_ptr").where(~F.col("src").rlike(typed) & ~F.col("dst").rlike(typed))
    loads = flow(LOAD, "load")
    geps = found(FIELD_ADDRESS)
    fields = geps.groupBy("owner", "dst").agg(F.max_by(F.struct("struct_type", F.col("field_idx").cast("int").alias("field_idx"), "base", "ord"), "ord").alias("g")).select("owner", "dst", "g.*")
    slots = found(SLOT_ADDRESS).groupBy("owner", "dst").agg(F.max_by(F.struct("base", F.col("slot").cast("int").alias("slot")), "ord").alias("g")).select("owner", "dst", "g.*")

    tables = rows.where("rare is not null and fn is null and not open").where(F.startswith("text", F.lit(TABLE_START))).select("file", F.col("head").alias("line_no"), "text")
    tables = tables.select("file", "line_no", F.regexp_extract("text", DISPATCH_TABLE, 1).alias("vtable"), F.regexp_extract("text", DISPATCH_TABLE, 2).alias("entries")).where("vtable != ''")
    last = tables.groupBy("vtable").agg(F.max_by("entries", F.struct("file", "line_no")).alias("entries"))
    slot_fn = F.regexp_extract("entry", "@([a-zA-Z_][a-zA-Z0-9_]*)", 1)
    entries = last.select("vtable", F.posexplode(F.split("entries", ",")).alias("slot", "entry")).select(
        "vtable", "slot", F.when((slot_fn != "") & ~slot_fn.rlike("^_ZT[IS]"), slot_fn).alias("fn")
    )
    return ProgramFacts(functions, call_sites, indirect, stores.unionByName(pointers).unionByName(loads), fields, entries, slots, found(LOAD_GLOBAL).select("owner", "dst", "src", "ord"))
