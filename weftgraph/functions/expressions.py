"""Column expressions over formulas: comments and strings off, references, function classes, keys.

Regular expressions at the token level, so they see names and calls, not nesting or scopes.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What a function tells of a formula. Fixed values.
FUNCTION_CLASSES = {
    "selector": ["SELECTEDVALUE", "VALUES", "HASONEVALUE", "ISFILTERED", "ISCROSSFILTERED", "FILTERS"],
    "filter_context": ["CALCULATE", "CALCULATETABLE", "FILTER", "TREATAS", "REMOVEFILTERS", "ALL", "ALLEXCEPT", "ALLSELECTED", "KEEPFILTERS"],
    "relationship": ["USERELATIONSHIP", "CROSSFILTER"],
    "conditional": ["IF", "SWITCH", "COALESCE"],
    "formatting": ["FORMAT", "SELECTEDMEASURE", "SELECTEDMEASUREFORMATSTRING"],
}
#: Statements that a read-only query must not hold. Fixed values.
WRITING = ["INSERT", "UPDATE", "DELETE", "ALTER", "CREATE", "DROP", "MERGE", "TRUNCATE", "GRANT", "REVOKE"]

# The lexical rules of formulas; every pattern below is put together from these.
STRING = r'"(?:[^"]|"")*"'
COMMENT = r"(?://|--)[^\n]*|/\*[\s\S]*?\*/"
QUOTED = r"'(?:[^']|'')+'"
BRACKETED = r"\[(?:[^\]]|\]\])+\]"
WORD = r"[A-Za-z_]\w*"
REFERENCE = rf"(?:{QUOTED}\s*|{WORD})?{BRACKETED}"
#: One alternation, so that what begins first wins; quoted tables stay as group 1.
SKIPPED = rf"({QUOTED})|{STRING}|{COMMENT}"
TOKEN = rf"{STRING}|{COMMENT}|{REFERENCE}|{QUOTED}|\w+|[\s\S]"


def tokens(c: Column) -> Column:
    """The formula cut into strings, comments, references, words and single signs; joined they are the formula."""
    return F.regexp_extract_all(c, F.lit(TOKEN), F.lit(0))


def reference_table(ref: Column) -> Column:
    """The table of a reference token, quotes undone; null for a bare ``[name]``."""
    owner = F.rtrim(F.substring_index(ref, "[", 1))
    quoted = F.regexp_extract(ref, rf"^({QUOTED})", 1)
    inner = F.replace(F.substring(quoted, F.lit(2), F.length(quoted) - 2), F.lit("''"), F.lit("'"))
    return F.when(quoted != "", inner).when(owner != "", owner)


def reference_name(ref: Column) -> Column:
    """The name of a reference token, doubled brackets undone."""
    held = F.regexp_extract(ref, rf"({BRACKETED})$", 1)
    return F.replace(F.substring(held, F.lit(2), F.length(held) - 2), F.lit("]]"), F.lit("]"))


def bare(c: Column) -> Column:
    """The formula with a blank for every comment and string literal."""
    return F.regexp_replace(c, SKIPPED, "$1 ")


def references(c: Column) -> Column:
    """Distinct (table, name) structs; the table is null for a bare ``[name]``, doubled quotes and brackets are undone."""
    found = F.regexp_extract_all(bare(c), F.lit(REFERENCE), F.lit(0))
    return F.array_distinct(F.transform(found, lambda r: F.struct(reference_table(r).alias("table"), reference_name(r).alias("name"))))


def functions(c: Column) -> Column:
    """Distinct upper-case names of the functions called, sorted."""
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(bare(c), F.lit(r"([A-Za-z][A-Za-z0-9.]*)\s*\("), F.lit(1)), lambda f: F.upper(f))))


def function_classes(c: Column) -> Column:
    """The classes, in fixed order, of which a function is called."""
    called = functions(c)
    return F.array_compact(F.array(*[F.when(F.arrays_overlap(called, F.array(*map(F.lit, names))), name) for name, names in FUNCTION_CLASSES.items()]))


def formula_key(c: Column) -> Column:
    """What two formulas share if only white space, comments, letter case or table quotes differ; strings count."""
    idle = rf"{COMMENT}|\s+|'(?={WORD}'\[)|(?<=\w)'(?=\[)"
    code = F.regexp_replace(c, rf"({STRING})|{idle}", "$1")
    return F.lower(code)


def plain_text(c: Column) -> Column:
    """Text with one kind of line end and no blanks before it."""
    return F.regexp_replace(F.regexp_replace(c, r"\r\n?", "\n"), r"[ \t]+(?=\n|$)", "")


def read_only(c: Column) -> Column:
    """False where a statement holds a writing keyword as a word, in any letter case; null stays null."""
    return ~c.rlike(rf"(?i)\b(?:{'|'.join(WRITING)})\b")


def call_references(c: Column) -> Column:
    """(call, function, argument, ref) of what stands inside each function's parentheses, however deep; arguments count from 0.

    ``ref`` is a reference token, a quoted table or a bare word that is not called; calls are numbered by where they open.
    """
    code = F.filter(tokens(c), lambda t: (F.trim(t) != "") & ~t.rlike(rf"^(?:{STRING}|{COMMENT})$") & ~t.rlike(r"^\s$"))
    frame, found = "array<struct<call:int,f:string,a:int>>", "array<struct<call:int,function:string,argument:int,ref:string>>"
    start = F.struct(F.array().cast(frame).alias("open"), F.lit("").alias("word"), F.lit(0).alias("calls"), F.array().cast(found).alias("out"))

    def told(state: Column, ref: Column) -> Column:
        named = F.filter(state["open"], lambda x: x["f"] != "")
        return F.concat(state["out"], F.transform(named, lambda x: F.struct(x["call"].alias("call"), x["f"].alias("function"), x["a"].alias("argument"), ref.alias("ref"))))

    def step(s: Column, t: Column) -> Column:
        out = F.when((s["word"] != "") & (t != "("), told(s, s["word"])).otherwise(s["out"])
        opens, closes = t.isin("(", "{"), t.isin(")", "}")
        top = F.struct(s["calls"].alias("call"), F.when(t == "(", F.upper(s["word"])).otherwise("").alias("f"), F.lit(0).alias("a"))
        last = F.size(s["open"]) - 1
        bumped = F.transform(s["open"], lambda x, i: F.struct(x["call"].alias("call"), x["f"].alias("f"), (x["a"] + F.when(i == last, 1).otherwise(0)).alias("a")))
        stack = F.when(opens, F.array_append(s["open"], top)).when(closes & (last >= 0), F.slice(s["open"], 1, F.greatest(last, F.lit(0)))).when(t == ",", bumped).otherwise(s["open"])
        is_ref = t.rlike(rf"^(?:{REFERENCE}|{QUOTED})$")
        after = F.struct(s["open"].alias("open"), F.lit("").alias("word"), s["calls"].alias("calls"), out.alias("out"))
        return F.struct(stack.alias("open"), F.when(t.rlike(r"^\w+$"), t).otherwise("").alias("word"), (s["calls"] + F.when(t == "(", 1).otherwise(0)).alias("calls"), F.when(is_ref, told(after, t)).otherwise(out).alias("out"))

    return F.aggregate(code, start, step, lambda s: s["out"])


def variables(c: Column) -> Column:
    """Distinct folded names that ``VAR`` declares, sorted."""
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(bare(c), F.lit(r"(?i)\bVAR\s+(\w+)\s*="), F.lit(1)), lambda v: F.lower(v))))


#: Words that stand alone and name nothing. Fixed values.
KEYWORDS = ["VAR", "RETURN", "TRUE", "FALSE", "IN", "NOT", "AND", "OR", "ASC", "DESC", "ORDER", "BY", "START", "AT", "DEFINE", "EVALUATE", "MEASURE", "COLUMN", "TABLE"]


def scoped_references(c: Column) -> Column:
    """Distinct (kind, table, name) of what a formula refers to, read with the variables that hold at each place.

    ``column`` is ``Table[Name]``, ``measure`` a bare ``[Name]``, ``table`` a quoted name or a word that is not called. A variable
    hides a table of its name, in words and before brackets, but never a bracketed name or a quoted one. It holds from the next VAR or
    RETURN after its own definition to the comma or closing bracket that ends the block it was declared in.
    """
    code = F.filter(tokens(c), lambda t: (F.trim(t) != "") & ~t.rlike(rf"^(?:{STRING}|{COMMENT})$"))
    names, found = "array<struct<name:string,depth:int>>", "array<struct<kind:string,table:string,name:string>>"
    start = F.struct(F.array().cast(names).alias("held"), F.array().cast(names).alias("coming"), F.lit(0).alias("depth"), F.lit("").alias("word"), F.lit(False).alias("naming"), F.array().cast(found).alias("out"))
    ref = lambda kind, table, name: F.array(F.struct(F.lit(kind).alias("kind"), table.alias("table"), name.alias("name")))
    none = F.lit(None).cast("string")
    hidden = lambda s, word: F.exists(s["held"], lambda v: v["name"] == F.lower(word))

    def step(s: Column, t: Column) -> Column:
        declares = F.upper(t) == "VAR"
        opens, closes = t.isin("(", "{"), t.isin(")", "}")
        # the word before this token is a table unless it is called, a keyword, a number or a variable
        plain = (s["word"] != "") & (t != "(") & ~F.upper(s["word"]).isin(KEYWORDS) & ~s["word"].rlike("^[0-9]") & ~hidden(s, s["word"])
        out = F.when(plain, F.concat(s["out"], ref("table", s["word"], none))).otherwise(s["out"])
        owner = reference_table(t)
        is_ref = t.rlike(rf"^{REFERENCE}$")
        bound = is_ref & owner.isNotNull() & ~t.startswith("'") & hidden(s, owner)
        told = F.when(is_ref & ~bound, F.when(owner.isNull(), ref("measure", none, reference_name(t))).otherwise(ref("column", owner, reference_name(t)))).when(
            t.rlike(rf"^{QUOTED}$"), ref("table", F.replace(F.substring(t, F.lit(2), F.length(t) - 2), F.lit("''"), F.lit("'")), none)
        )
        out = F.when(told.isNotNull(), F.concat(out, told)).otherwise(out)
        word = t.rlike(r"^\w+$")
        named = s["naming"] & word
        coming = F.when(named, F.array_append(s["coming"], F.struct(F.lower(t).alias("name"), s["depth"].alias("depth")))).otherwise(s["coming"])
        begins = declares | (F.upper(t) == "RETURN")
        ready = lambda v: v["depth"] == s["depth"]
        held = F.when(begins, F.concat(s["held"], F.filter(s["coming"], ready))).otherwise(s["held"])
        coming = F.when(begins, F.filter(s["coming"], lambda v: ~ready(v))).otherwise(coming)
        ends = closes | (t == ",")
        inside = lambda vs: F.filter(vs, lambda v: v["depth"] < s["depth"])
        depth = F.greatest(s["depth"] + F.when(opens, 1).when(closes, -1).otherwise(0), F.lit(0))
        return F.struct(
            F.when(ends, inside(held)).otherwise(held).alias("held"), F.when(ends, inside(coming)).otherwise(coming).alias("coming"), depth.alias("depth"),
            F.when(word & ~named, t).otherwise("").alias("word"), declares.alias("naming"), out.alias("out"),
        )

    return F.array_distinct(F.aggregate(F.array_append(code, F.lit(";")), start, step, lambda s: s["out"]))


#: Types that a literal table's columns may have. Fixed values.
LITERAL_TYPES = ["BOOLEAN", "LOGICAL", "CURRENCY", "DECIMAL", "DATETIME", "DOUBLE", "INTEGER", "INT64", "STRING", "TEXT"]


def literal_table(c: Column) -> Column:
    """(columns, rows) of a DATATABLE whose cells are all constants, a row as wide as the columns; null for any other formula."""
    number = r"-?\s*\d+(?:\.\d+)?(?:[eE][+-]?\d+)?"
    call = rf"(?i:DATE|TIME)\s*\(\s*{number}\s*,\s*{number}\s*,\s*{number}\s*\)|(?i:BLANK)\s*\(\s*\)|(?i:TRUE|FALSE)\b(?:\s*\(\s*\))?"
    constant = rf"(?:{call}|{STRING}|{number})"
    row = rf"[{{(]\s*{constant}(?:\s*,\s*{constant})*\s*[}})]"
    column = rf"({STRING})\s*,\s*(?i:{'|'.join(LITERAL_TYPES)})\s*,"
    whole = rf"^\s*(?i:DATATABLE)\s*\(\s*(?:{column}\s*)+\{{\s*(?:{row}\s*(?:,\s*{row}\s*)*)?\}}\s*\)\s*$"
    code = F.regexp_replace(c, rf"({STRING})|{COMMENT}", "$1 ")
    head = F.regexp_extract(code, rf"^\s*\w+\s*\(\s*((?:{column}\s*)+)", 1)
    names = F.transform(F.regexp_extract_all(head, F.lit(column), F.lit(1)), lambda n: F.replace(F.substring(n, F.lit(2), F.length(n) - 2), F.lit('""'), F.lit('"')))
    rows = F.regexp_extract_all(F.substring(code, F.length(head) + F.instr(code, "(") + 1, F.length(code)), F.lit(row), F.lit(0))
    fits = F.forall(rows, lambda r: F.regexp_count(r, F.lit(constant)) == F.size(names)) & (F.size(F.array_distinct(names)) == F.size(names))
    return F.when(code.rlike(whole) & fits, F.struct(names.alias("columns"), F.size(rows).alias("rows")))
