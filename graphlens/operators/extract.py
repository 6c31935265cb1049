"""Symbols, imports and call sites from source text, as one Spark job.

Every text is read once. A small lexer sets comments and texts in quotes apart;
code inside texts (interpolation) stays. Python is then read by its own parser.
Every other language is a row of `RULES`, patterns for its definitions, imports
and calls that are applied to the lines. Blocks follow braces where the language
has them, else indentation: a definition reaches to the last line before one
indented no deeper, including an `end` in the same column. Python that does not
parse is read by rules as well.

Definitions inside functions are not reported and their calls belong to the
outer function, except for languages marked `nested`, where they are reported
and calls count for every function around them.
"""

from __future__ import annotations

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphlens.functions.modules import module_qname, separator
from graphlens.operators.lexing import apart, block_ends, read_python, segments, use_leaves
from graphlens.session import cut
from graphlens.sources.components import as_script, script_blocks
from graphlens.sources.notebooks import notebook_source
from graphlens.sources.trees import file_label, language

WORD = r"[A-Za-z_]\w*"
MODIFIERS = (
    r"(?:(?:public|private|protected|internal|static|final|abstract|virtual|override|sealed|async|partial|readonly|extern|"
    r"synchronized|native|default|inline|constexpr|explicit|open|data|suspend|inner|companion|lateinit|operator|infix|"
    r"implicit|lazy|case|mutating|class|fileprivate|convenience|required|pub|unsafe|const|export|local)\s+)*"
)
TYPED = r"(?:[\w<>\[\],.?:*&~]++\s++)+[*&]*"  # a return type before a name
NOT_A_NAME = "if for while switch catch return new else do try sizeof throw await typeof elif with and or not in is lambda yield assert del print".split()

# Words that look like calls and are not, over all languages.
CALL_WORDS = (
    "if", "for", "while", "switch", "catch", "return", "else", "elif", "do", "try", "sizeof", "throw", "await", "typeof", "match",
    "with", "and", "or", "not", "in", "is", "lambda", "yield", "assert", "del", "fn", "func", "fun", "function", "def", "sub", "new", "returns",
    "until", "unless", "when", "elseif", "except", "raise", "loop", "guard", "super", "impl", "end",
)


# Words that start a statement and call nothing, where calls need no parentheses.
RUBY_WORDS = "def|class|module|if|unless|while|until|for|case|when|return|yield|end|else|elsif|begin|rescue|ensure|and|or|not|in|do|then|alias|undef|super|self|nil|true|false|require|require_relative|load|autoload"
LUA_WORDS = "return|and|or|not|in|do|then|else|elseif|repeat|until|local|end|if|while|for|function|require"
POWERSHELL_WORDS = "function|filter|param|if|elseif|else|foreach|for|while|switch|return|begin|process|end|try|catch|finally|throw|trap|in|do|until|break|continue|class|enum|using|import-module"
FOREACH = ("csharp", "php", "perl", "powershell")
RUBY_LOADS = ("require", "require_relative", "load", "autoload")


def _rule(comment="//", types="", scopes="", functions="", methods="", package="", imports=(), async_="", call="", bare_call="", arrows="", nested=False, methods_are_typed=True, braces=True):
    # group 1 is the target; what follows it is only looked at
    call = call or rf"(?:{WORD}\s*(?:\.|::|->|\?\.)\s*)*{WORD}(?=\s*\()"
    return {
        "comment": comment, "types": types, "scopes": scopes, "functions": functions, "methods": methods, "package": package,
        "imports": imports, "async": async_, "call": f"({call}|{bare_call})" if bare_call else f"({call})", "arrows": arrows, "nested": nested,
        "has_methods": methods_are_typed, "braces": braces,
    }


# An import pattern names its module (group 1), its alias (group 2, may be empty), and text that marks it relative (group 3, may be empty).
PARAMETERS = r"\s*\((?:[^;]*|[^;{]*\{.*)$"  # up to the end of the line, unless it ends as a statement
C_LIKE = rf"^(?!\s*(?:{'|'.join(NOT_A_NAME)})\b)\s*{MODIFIERS}{TYPED}(~?{WORD}){PARAMETERS}"
INCLUDE_QUOTED = r'(?m)^\s*#\s*include\s+"([^"]+)()(")'
INCLUDE_SYSTEM = r"(?m)^\s*#\s*include\s+<([^>]+)()()"

RULES = {
    "python": _rule(
        "#", rf"^\s*class\s+({WORD})", "", rf"^\s*(?:async\s+)?def\s+({WORD})", async_=r"^\s*async\s",
        imports=(r"(?m)^[ \t]*import[ \t]+([^\n#]+)()()", r"(?m)^[ \t]*from[ \t]+(\S+[ \t]+import[ \t]+(?:\([^)]*\)|[^\n#]+))()()"),
        braces=False,
    ),
    "javascript": _rule(
        "//", rf"^\s*(?:export\s+)?(?:default\s+)?(?:abstract\s+)?class\s+({WORD})", "",
        rf"^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s*({WORD})",
        rf"^\s+(?:(?:static|async|get|set|public|private|protected|readonly|override)\s+)*\*?(?!(?:{'|'.join(NOT_A_NAME)}|function)\b)({WORD})\s*\([^;]*\{{",
        imports=(r"""(?m)^\s*import\b[^;'"`]*["'`]([^'"`]+)["'`]()()""",), async_=r"\basync\b",
        arrows=rf"^.*?(?:\bfunction\b\s*\*?\s*({WORD})?(?=\s*\()|(?:\([^()]*(?:\([^()]*\)[^()]*)*\)|{WORD})\s*(?::[^=()]*)?=>)",
    ),
    "rust": _rule(
        "//", rf"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:struct|enum|trait|union)\s+({WORD})",
        rf"^\s*(?:unsafe\s+)?(?:impl(?:<[^>]*>)?\s+(?:[\w:<>]+\s+for\s+)?|(?:pub\s+)?mod\s+)({WORD})[^;]*$",
        rf"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:(?:const|async|unsafe|extern)\s+)*fn\s+({WORD})",
        imports=(r"(?m)^\s*(?:pub(?:\([^)]*\))?\s+)?use\s+([^;]+);()()",), async_=r"\basync\s",
        call=rf"(?:{WORD}\s*(?:\.|::)\s*)*{WORD}(?=!?\s*\()",
    ),
    "go": _rule(
        "//", rf"^(?:type\s+|\s+)({WORD})\s+(?:struct|interface)\b", "", rf"^func\s+({WORD})", rf"^func\s*\(\s*(?:{WORD}\s+)?\*?({WORD}[^)]*\)\s*{WORD})",
        imports=(r'(?m)^import[ \t]+(?=(?:[\w.]+[ \t]+)?"([^"\n]+)")([\w.]*)()', r'(?m)^[ \t]+(?=(?:[\w.]+[ \t]+)?"([^"\n]+)"[ \t]*$)([\w.]*)()'),
    ),
    "java": _rule(
        "//", rf"^\s*{MODIFIERS}(?:class|interface|enum|record)\s+({WORD})", "", C_LIKE,
        rf"^\s+{MODIFIERS}(?!(?:{'|'.join(NOT_A_NAME)})\b)({WORD})\s*\([^;{{]*\{{", package=r"(?m)^\s*package\s+([\w.]+)",
        imports=(r"(?m)^\s*import\s+(?:static\s+)?(\w+(?:\.\w+)*)()()",),
    ),
    "ruby": _rule(
        "#", rf"^\s*(?:class|module)\s+({WORD}(?:::{WORD})*)", "", rf"^\s*def\s+(?:self\.)?({WORD}[?!=]?)",
        imports=(r"""(?m)^\s*(?:require|load|autoload)\b[\s(]*["']([^"']+)["']()()""", r"""(?m)^\s*require_relative\b[\s(]*["']([^"']+)["']()((?<=["']))"""),
        call=rf"(?:{WORD}\s*(?:\.|::|&\.)\s*)*{WORD}[?!]?(?=\s*\()", bare_call=rf"(?<=[\w)\]}}]\.){WORD}[?!]?(?!\w|[?!]|\s*\()|^[ \t]*(?!(?:{RUBY_WORDS})\b){WORD}[?!]?(?=[ \t]+(?!(?:if|unless|while|until|and|or|do|then|in|rescue)\b)[\w\"':@\[$~-])", braces=False,
    ),
    "c": _rule(
        "//", rf"^\s*(?:typedef\s+)?(?:struct|union|enum)\s+({WORD})[^;()]*(?:\{{.*)?$", "", C_LIKE, "",
        imports=(INCLUDE_SYSTEM, INCLUDE_QUOTED), methods_are_typed=False,
    ),
    "cpp": _rule(
        "//", rf"^\s*(?:template\s*<[^>]*>\s*)?(?:class|struct|union)\s+({WORD})[^;()]*(?:\{{.*)?$", rf"^\s*(?:inline\s+)?namespace\s+({WORD})",
        rf"^(?!\s*(?:{'|'.join(NOT_A_NAME)}|using)\b)\s*{MODIFIERS}(?:{TYPED})?((?:{WORD}::)*~?{WORD}){PARAMETERS}", "",
        imports=(INCLUDE_SYSTEM, INCLUDE_QUOTED, r"(?m)^\s*using\s+(?!namespace)([\w:]+)\s*;()()"),
    ),
    "csharp": _rule(
        "//", rf"^\s*{MODIFIERS}(?:class|interface|struct|record|enum)\s+({WORD})", "", C_LIKE, "", package=r"(?m)^\s*namespace\s+([\w.]+)",
        imports=(r"(?m)^\s*(?:global\s+)?using\s+(?:static\s+)?([\w.]+)\s*;()()",), async_=r"\basync\s",
    ),
    "kotlin": _rule(
        "//", rf"^\s*{MODIFIERS}(?:enum\s+|annotation\s+)?(?:class|object|interface)\s+({WORD})", "", rf"^\s*{MODIFIERS}fun\s+(?:<[^>]*>\s*)?(?:{WORD}\.)?({WORD})",
        package=r"(?m)^\s*package\s+([\w.]+)", imports=(r"(?m)^\s*import\s+([\w.]+)()()",), async_=r"\bsuspend\s",
        bare_call=rf"(?<=\.){WORD}(?=\s*\{{)",
    ),
    "scala": _rule(
        "//", rf"^\s*{MODIFIERS}(?:class|object|trait|enum)\s+({WORD})", "", rf"^\s*{MODIFIERS}def\s+({WORD})", package=r"(?m)^\s*package\s+([\w.]+)",
        imports=(r"(?m)^\s*import\s+([\w.]+\w)()()",),
        bare_call=rf"(?<=\.){WORD}(?=\s*\{{)",
    ),
    "swift": _rule(
        "//", rf"^\s*{MODIFIERS}(?:class|struct|protocol|enum|extension)\s+({WORD})", "", rf"^\s*{MODIFIERS}func\s+({WORD})", rf"^\s*{MODIFIERS}(init|deinit)\b",
        imports=(r"(?m)^\s*import\s+(?:(?:class|struct|func|enum|protocol)\s+)?([\w.]+)()()",), async_=r"\basync\b",
        bare_call=rf"(?<=\.){WORD}(?=\s*\{{)",
    ),
    "php": _rule(
        "//", rf"^\s*{MODIFIERS}(?:class|interface|trait|enum)\s+({WORD})", "", rf"^\s*{MODIFIERS}function\s+&?({WORD})", package=r"(?m)^\s*namespace\s+([\w\\]+)",
        imports=(r"(?m)^use\s+(?:function\s+|const\s+)?([\w\\]+)()()",),
    ),
    "solidity": _rule(
        "//", rf"^\s*(?:abstract\s+)?(?:contract|interface|library)\s+({WORD})", "", rf"^\s*(?:function|modifier)\s+({WORD})", r"^\s*(constructor|receive|fallback)\s*\(",
        imports=(r"""(?m)^\s*import\b[^"';]*["'](?!\.)([^"']+)["']()()""", r"""(?m)^\s*import\b[^"';]*["']((?=\.)[^"']+)["']()((?<=["']))"""),
    ),
    "dart": _rule(
        "//", rf"^\s*(?:abstract\s+)?(?:class|mixin|extension|enum)\s+({WORD})", "", C_LIKE, "", imports=(r"""(?m)^\s*(?:import|export)\s+["']([^"']+)["']()()""",),
    ),
    "r": _rule(
        "#", "", "", rf"^\s*([\w.]+)\s*(?:<-|=)\s*function\b", imports=(r"""\b(?:library|require|requireNamespace|loadNamespace|source)\(\s*["']?([\w./]+)()()""",), methods_are_typed=False,
    ),
    "perl": _rule("#", "", "", rf"^\s*sub\s+({WORD})", package=r"(?m)^\s*package\s+([\w:]+)", imports=(r"""(?m)^\s*(?:use|require|no)\s+["']?([A-Za-z_][\w:.]*)()()""",), nested=True, methods_are_typed=False),
    "lua": _rule("--", "", "", r"^\s*(?:local\s+)?function\s+([\w.:]+)", imports=(r"""\brequire\s*\(?\s*["'\[]+([^"'\]]+)()()""",), nested=True, methods_are_typed=False, bare_call=rf"(?!(?:{LUA_WORDS})\b){WORD}(?=\s*(?:[\"'{{]|\[\[))", braces=False),
    "zig": _rule(
        "//", rf"^\s*(?:pub\s+)?const\s+({WORD})\s*=\s*(?:packed\s+|extern\s+)?(?:struct|enum|union)\b", "", rf"^\s*(?:(?:pub|export|inline|extern)\s+)*fn\s+({WORD})",
        imports=(r"""@import\(\s*"([^"]+)"()()""",), nested=True, methods_are_typed=False,
    ),
    "powershell": _rule(
        "#", "", "", r"^\s*(?i:function|filter)\s+(?:\w+:)?([\w-]+)", imports=(r"""(?mi)^\s*(?:Import-Module|using\s+(?:module|namespace))\s+["']?([\w./\\:-]+)()()""",), nested=True, methods_are_typed=False,
        call=rf"(?:^|(?<=[|;{{(=&]))[ \t]*(?!(?i:{POWERSHELL_WORDS})\b)[A-Za-z_][\w-]*(?=[\s();|}}]|$)(?!\s*=)|(?<=\.|::){WORD}(?=\()",
    ),
    "julia": _rule(
        "#", rf"^\s*(?:mutable\s+|abstract\s+|primitive\s+)?(?:struct|type)\s+({WORD})", rf"^\s*(?:bare)?module\s+({WORD})",
        rf"^\s*(?:function|macro)\s+(?:{WORD}\.)*({WORD}!?)", rf"^\s*({WORD}!?)\([^=]*\)\s*=[^=]", imports=(r"(?m)^\s*(?:using|import)\s+([\w.]+)()()",), methods_are_typed=False,
        braces=False,
    ),
    "nix": _rule("#", "", "", r"^\s*([\w.'-]+)\s*=\s*(?:\{[^}=]*\}|\w+)\s*:", imports=(r"\bimport\s+<?(?!\.)([^\s;)>]+)()()", r"\bimport\s+((?=\.)[^\s;)]+)()((?<=\S))"), call=rf"(?<![\w.'-])(?!(?:let|in|with|rec|inherit|if|then|else|assert|import|or)\b){WORD}(?=[ \t]+(?:\(|\"|\{{|\[|(?!(?:in|then|else|or)\b)[A-Za-z_]))", nested=True, braces=False, methods_are_typed=False),
}
NEVER = r"(?!)"
ANONYMOUS = "<anon>"

def _head(pattern: str) -> str:
    """The pattern up to the name, without what it demands of the parameters."""
    for tail in (PARAMETERS, r"\s*\([^;", r"\s*\("):
        if pattern.endswith(tail) or (tail == r"\s*\([^;" and tail in pattern):
            return pattern[: pattern.rindex(tail)]
    return pattern


def rule_of(lang: Column) -> Column:
    """The row of the rule table for a language, null for languages without rules.

    The table has one row per language and is a literal of the plan, so files
    meet their rules without a join.
    """
    rows: list[Column] = []
    for name, r in RULES.items():
        fields = [F.lit(r[k] or NEVER).alias(k) for k in ("types", "scopes", "functions", "methods", "arrows", "package", "async")]
        fields += [F.lit(r[k]).alias(k) for k in ("call", "nested", "has_methods", "braces")]
        fields.append(F.lit("|".join(_head(r[k]) for k in ("functions", "methods", "arrows") if r[k])).alias("head"))
        fields.append(F.array(*[F.lit(p) for p in r["imports"]]).alias("imports"))
        rows += [F.lit(name), F.struct(*fields)]
    return F.element_at(F.create_map(*rows), lang)


def with_rules(units_: DataFrame) -> DataFrame:
    return units_.withColumn("rule", rule_of(F.col("lang"))).filter(F.col("rule").isNotNull()).select("*", "rule.*").drop("rule")


def units(files: DataFrame) -> DataFrame:
    """Texts to extract from: a file, each script block of a component, the code of a notebook.

    repo_id, path (as stored), unit (the path symbols are named after), lang,
    label (what the file row says), code, shift (lines before the code).
    """
    text = files.withColumn("content", F.col("content").cast("string"))
    kind = language(F.col("path"))
    plain = text.filter(~kind.isin("vue", "svelte", "ipynb")).select(
        "repo_id", "path", F.col("path").alias("unit"), kind.alias("lang"), file_label(F.col("path")).alias("label"),
        F.col("content").alias("code"), F.lit(0).alias("shift"),
    )
    blocks = script_blocks(text.filter(kind.isin("vue", "svelte")).select("repo_id", "path", "content")).select(
        "repo_id", "path", as_script(F.col("path"), F.col("ending")).alias("unit"), F.lit("javascript").alias("lang"),
        language(F.col("path")).alias("label"), "code", F.col("line_offset").alias("shift"),
    )
    books = text.filter(kind == "ipynb").withColumn("nb", notebook_source(F.col("content"))).filter(F.col("nb").isNotNull()).select(
        "repo_id", "path", as_script(F.col("path"), F.col("nb.ending")).alias("unit"), F.col("nb.language").alias("lang"),
        F.concat(F.lit("ipynb/"), "nb.language").alias("label"), F.col("nb.code").alias("code"), F.lit(0).alias("shift"),
    )
    return plain.unionByName(blocks).unionByName(books)


NEST = T.StructType([
    T.StructField("ends", T.ArrayType(T.IntegerType())),
    T.StructField("around", T.ArrayType(T.ArrayType(T.IntegerType()))),
])


@F.pandas_udf(NEST)
def _nest(indents: pd.Series, roles: pd.Series, texts: pd.Series, braces: pd.Series) -> pd.DataFrame:
    """Per line: where the block opened there ends, and the open definitions around it.

    Roles: 0 text, 1 definition, 2 closes a block, 3 continues the line before,
    -1 blank. Lines are counted from 0. Braces decide where a definition has some.
    """
    all_ends, all_around = [], []
    for ind, rol, text, braced in zip(indents, roles, texts, braces, strict=True):
        if ind is None:
            all_ends.append(None)
            all_around.append(None)
            continue
        starts = [i for i, role in enumerate(rol) if role == 1]
        known = {i: e for i, e in zip(starts, block_ends("\n".join(text), starts), strict=True) if e >= 0} if braced else {}
        ends, around, open_, last = [0] * len(ind), [], [], 0
        for i, (depth, role) in enumerate(zip(ind, rol, strict=True)):
            if role >= 0:
                while open_:
                    d = open_[-1]
                    if not (i > known[d] if d in known else ind[d] > depth or (ind[d] == depth and role < 2)):
                        break
                    ends[open_.pop()] = known.get(d, last)
                last = i
            around.append(list(open_))
            if role == 1:
                open_.append(i)
            elif role == 2 and open_ and open_[-1] not in known and ind[open_[-1]] == depth:
                ends[open_.pop()] = i
        for d in open_:
            ends[d] = known.get(d, last)
        all_ends.append(ends)
        all_around.append(around)
    return pd.DataFrame({"ends": all_ends, "around": all_around})


APART = T.StructType([
    T.StructField("plain", T.StringType()), T.StructField("bare", T.ArrayType(T.StringType())), T.StructField("at", T.ArrayType(T.IntegerType())),
])


@F.pandas_udf(APART)
def _apart(code: pd.Series, lang: pd.Series, braces: pd.Series) -> pd.DataFrame:
    """The text without comments, its lines (cut at braces) without texts in quotes either, and which line each part is on."""
    out = []
    for c, x, braced in zip(code, lang, braces, strict=True):
        if c is None:
            out.append((None, None, None))
            continue
        plain, bare = apart(c, x)
        out.append((plain, *(segments(bare) if braced else (bare.split("\n"), list(range(bare.count("\n") + 1))))))
    return pd.DataFrame(out, columns=["plain", "bare", "at"], dtype=object)


_NODE = [("name", pa.string()), ("qualified_name", pa.string()), ("start_line", pa.int32()), ("end_line", pa.int32())]
PARSED = pa.struct([
    ("functions", pa.list_(pa.struct([
        *_NODE, ("is_method", pa.bool_()), ("is_async", pa.bool_()), ("body_sha", pa.string()), ("class_qname", pa.string()), ("doc", pa.string()),
    ]))),
    ("classes", pa.list_(pa.struct([*_NODE, ("doc", pa.string())]))),
    ("calls", pa.list_(pa.struct([("caller_qname", pa.string()), ("callee_name", pa.string()), ("line", pa.int32()), ("character", pa.int32())]))),
    ("imports", pa.list_(pa.struct([("module", pa.string()), ("alias", pa.string()), ("is_relative", pa.bool_())]))),
])
NODE_SQL = "name:string,qualified_name:string,start_line:int,end_line:int"
FUNCTION_SQL = f"array<struct<{NODE_SQL},is_method:boolean,is_async:boolean,body_sha:string,class_qname:string,doc:string>>"
CLASS_SQL = f"array<struct<{NODE_SQL},doc:string>>"
CALL_SQL = "array<struct<caller_qname:string,callee_name:string,line:int,character:int>>"
IMPORT_SQL = "array<struct<module:string,alias:string,is_relative:boolean>>"
PARSED_SQL = f"struct<functions:{FUNCTION_SQL},classes:{CLASS_SQL},calls:{CALL_SQL},imports:{IMPORT_SQL}>"


def _python(code: Column, module: Column) -> Column:
    """What a Python text defines, null for other languages and for text that does not parse."""

    def read(codes: pa.Array, modules: pa.Array) -> pa.Array:
        return pa.array([c.as_py() and read_python(c.as_py(), m.as_py()) for c, m in zip(codes, modules, strict=True)], PARSED)

    return F.arrow_udf(read, PARSED_SQL)(code, module)


def _use_trees(texts: Column) -> Column:
    """The leaves of the `use` statements of a Rust text."""

    def read(all_texts: pa.Array) -> pa.Array:
        out = [None if t is None else [leaf for x in t for leaf in use_leaves(x)] for t in all_texts.to_pylist()]
        return pa.array(out, PARSED.field("imports").type)

    return F.arrow_udf(read, IMPORT_SQL)(texts)


def _first(text: Column, pattern: Column) -> Column:
    """First group of a pattern held in a column, empty where it does not match."""
    return F.call_function("regexp_extract", text, pattern, F.lit(1))


def lines(files: DataFrame) -> DataFrame:
    """Units with what Python's parser found, else with lines, what each line defines and what is around it."""
    u = with_rules(units(files))
    is_python = F.col("lang") == "python"
    base = module_qname(F.col("unit"), F.col("lang"))
    package = F.nullif(_first(F.col("code"), F.col("package")), F.lit(""))
    module = F.when(F.col("lang") == "java", F.coalesce(package, F.lit(""))).otherwise(F.coalesce(package, base))
    u = u.withColumn("module", module).withColumn("sep", separator(F.col("lang")))
    u = u.withColumn("found", _python(F.when(is_python, F.col("code")), F.col("module")))
    u = u.withColumn("code", F.when(F.col("found.functions").isNull(), F.col("code")))
    u = u.withColumn("lexed", _apart("code", "lang", "braces")).withColumn("plain", F.col("lexed.plain")).withColumn("at", F.col("lexed.at")).withColumn("raw", F.split("code", "\n"))
    u = u.withColumn("seen", F.transform("lexed.bare", lambda s: F.when(s.rlike(r"^\s*#\s*include|^\s*#\s*define"), F.lit("")).otherwise(s))).drop("lexed")

    first = lambda s: F.regexp_extract(s, r"^\s*(\S+)", 1)
    pair = lambda k, s, c: F.struct(F.lit(k).alias("kind"), _first(s, F.col(c)).alias("name"))

    def define(s: Column) -> Column:
        found = F.when(F.rlike(s, F.col("functions")), pair("function", s, "functions"))
        for kind, c in (("class", "types"), ("scope", "scopes"), ("function", "methods"), ("function", "arrows")):
            found = found.when((F.col(c) != NEVER) & F.rlike(s, F.col(c)), pair(kind, s, c))
        # lines that close or continue a block define nothing
        return F.when(~s.rlike(r"^\s*($|[)\]{}]|end\b)"), found)

    def role(s: Column, d: Column) -> Column:
        w = first(s)
        return (
            F.when(d.isNotNull(), 1).when(w == "", -1).when(w.rlike(r"^(\}|end\b)"), 2).when(w.rlike(r"^[)\]{]"), 3).otherwise(0)
        )

    u = u.withColumn("def", F.transform("seen", define))
    u = u.withColumn("role", F.zip_with("seen", "def", role)).withColumn(
        "indent", F.transform("seen", lambda s: F.length(F.regexp_extract(F.replace(s, F.lit("\t"), F.lit("    ")), r"^( *)", 1)))
    )
    u = u.withColumn("nest", _nest("indent", "role", "seen", "braces"))
    return u.withColumn("info", F.transform("def", _named))


def package_names(files: DataFrame) -> DataFrame:
    """The name prefix of every unit: its package header, else its module name."""
    return lines(files).select("repo_id", "path", "lang", "module")


def _at(i: Column) -> Column:
    return F.element_at("def", i + 1)


def _qualified(parts: Column) -> Column:
    kept = F.filter(parts, lambda p: p.isNotNull() & (p != ""))
    return F.replace(F.array_join(kept, "\n"), F.lit("\n"), F.col("sep"))


def _named(d: Column, i: Column) -> Column:
    """What a definition is called and belongs to, from the definitions around it."""
    around = F.element_at("nest.around", i + 1)
    in_function = F.exists(around, lambda j: _at(j)["kind"] == "function")
    parents = F.transform(F.filter(around, lambda j: _at(j)["kind"] != "function"), lambda j: _at(j)["name"])
    # a receiver or an out-of-line scope names the class: `Type) Name` in Go, `Type::Name` in C++
    written = d["name"]
    is_fn = d["kind"] == "function"
    receiver = (F.col("lang") == "go") & written.contains(")")
    out_of_line = (F.col("lang") == "cpp") & written.contains("::") & is_fn
    owner = F.when(receiver, F.regexp_extract(written, rf"^({WORD})", 1)).when(out_of_line, F.regexp_extract(written, rf"^(.*)::~?{WORD}$", 1))
    name = F.when(owner.isNotNull(), F.regexp_extract(written, rf"(~?{WORD})$", 1)).when(written == "", ANONYMOUS).otherwise(written)
    flat = ~F.col("has_methods") & (F.col("lang") != "julia") & is_fn
    # an out-of-line owner replaces the scopes around it
    scope = F.when(owner.isNotNull(), F.array(owner)).when(flat, F.array().cast("array<string>")).otherwise(parents)
    method = F.col("has_methods") & (F.size(scope) > 0) & (name != ANONYMOUS)
    return F.when(
        d.isNotNull(),
        F.struct(
            d["kind"].alias("kind"), name.alias("name"), _qualified(F.concat(F.array("module"), scope, F.array(name))).alias("full"),
            method.alias("method"), F.when(method, _qualified(F.concat(F.array("module"), scope))).alias("holder"),
            (~in_function | F.col("nested")).alias("reported"),
        ),
    )


def parsed(files: DataFrame) -> DataFrame:
    """(repo_id, path, functions, classes, calls, imports): what every unit holds, in arrays.

    It is stored (`cut`) before the tables below are taken from it, once for all of
    them where it is passed on, so texts are read once.
    """
    u = lines(files)
    none = lambda kind: F.expr(f"cast(array() as {kind})")
    all_of = lambda kind, sql, own: F.concat(F.coalesce(F.col(f"found.{kind}"), none(sql)), F.coalesce(own.cast(sql), none(sql))).alias(kind)
    u = u.withColumn("trees", _use_trees(F.when(F.col("lang") == "rust", _import_texts(F.col("imports")[0], 1))))
    return u.select(
        "repo_id", "path", all_of("functions", FUNCTION_SQL, _symbols("function")), all_of("classes", CLASS_SQL, _symbols("class")),
        all_of("calls", CALL_SQL, _calls()), all_of("imports", IMPORT_SQL, _imports()),
    )


def _symbols(kind: str) -> Column:
    """The reported definitions of a kind, put together while the file is one row."""

    def row(d: Column, i: Column) -> Column:
        start, end = F.element_at("at", i + 1), F.element_at("at", F.element_at("nest.ends", i + 1) + 1)
        body = F.regexp_replace(F.array_join(F.slice("raw", start + 1, end - start + 1), "\n"), r"^[ \t]+", "")
        node = [
            d["name"].alias("name"), d["full"].alias("qualified_name"),
            (start + 1 + F.col("shift")).alias("start_line"), (end + 1 + F.col("shift")).alias("end_line"),
        ]
        more = [
            d["method"].alias("is_method"), F.rlike(F.element_at("seen", i + 1), F.col("async")).alias("is_async"),
            F.sha1(body.cast("binary")).alias("body_sha"), d["holder"].alias("class_qname"),
        ]
        doc = F.lit(None).cast("string").alias("doc")
        return F.when(d["reported"] & (d["kind"] == kind), F.struct(*node, *(more if kind == "function" else []), doc))

    return F.filter(F.transform("info", row), lambda r: r.isNotNull())


def _calls() -> Column:
    """Calls written inside functions: caller, last part of the target, line and column."""
    info = lambda j: F.element_at("info", j + 1)
    shell = F.col("lang") == "powershell"

    def sites(s: Column, i: Column) -> Column:
        is_fn = F.coalesce(info(i)["kind"] == "function", F.lit(False))
        chain = F.filter(
            F.concat(F.element_at("nest.around", i + 1), F.when(is_fn, F.array(i)).otherwise(F.array().cast("array<int>"))),
            lambda j: (info(j)["kind"] == "function") & info(j)["reported"],
        )
        # of a definition line only what follows its parameters can be a call
        named = F.regexp_replace(F.regexp_replace(s, F.col("head"), F.lit("")), r"^\s*(?:<[^>]*>\s*)?\((?:[^()]|\([^()]*\))*\)", "")
        after = F.when(info(i)["name"] == ANONYMOUS, F.regexp_replace(s, F.col("arrows"), F.lit(""))).otherwise(named)
        owners = F.transform(F.when(F.col("nested"), chain).otherwise(F.slice(chain, F.lit(1), F.lit(1))), lambda j: info(j)["full"])
        targets = F.regexp_extract_all(F.when(is_fn & info(i)["reported"], after).otherwise(s), F.col("call"), F.lit(1))
        name = lambda t: F.when(shell, F.regexp_extract(t, r"([\w-]+)$", 1)).otherwise(F.regexp_extract(t, rf"({WORD}[?!]?)$", 1))
        at = F.element_at("at", i + 1)
        place = lambda t: F.greatest(F.call_function("locate", F.trim(t), F.element_at("raw", at + 1)) - 1, F.lit(0))
        found = F.transform(owners, lambda o: F.transform(targets, lambda t: F.struct(
            o.alias("caller_qname"), name(t).alias("callee_name"), (at + 1 + F.col("shift")).alias("line"), place(t).alias("character"),
        )))
        return F.when((F.size(owners) > 0) & (F.size(targets) > 0), F.flatten(found))

    found = F.flatten(F.filter(F.transform("seen", sites), lambda r: r.isNotNull()))
    loads, foreach = F.col("lang") == "ruby", F.col("lang").isin(*FOREACH)
    return F.filter(found, lambda c: ~c["callee_name"].isin(*CALL_WORDS) & (c["callee_name"] != "") & ~(
        (loads & c["callee_name"].isin(*RUBY_LOADS)) | (foreach & (c["callee_name"] == "foreach"))
    ))


def _import_texts(rule: Column, group: int) -> Column:
    return F.regexp_extract_all("plain", rule, F.lit(group))


def _imports() -> Column:
    """Imported names: module, alias, whether relative. Grouped forms are split."""

    def of(rule: Column) -> Column:
        relative = rule.rlike(r'\(\(\?<=|\(\)\("\)')
        both = F.zip_with(_import_texts(rule, 1), _import_texts(rule, 2), lambda m, a: F.struct(
            F.trim(m).alias("module"), F.nullif(a, F.lit("")).alias("alias"), relative.alias("is_relative"),
        ))
        return F.when(F.col("lang") == "python", F.flatten(F.transform(both, lambda b: _python_leaves(b["module"])))).otherwise(both)

    return F.coalesce(F.col("trees"), F.array_distinct(F.flatten(F.transform("imports", of))))


def _python_leaves(text: Column) -> Column:
    """The names of `a, b as c` or of `m import (a, b)`."""
    is_from = text.rlike(r"^\S+\s+import\s")
    mod = F.regexp_extract(text, r"^(\S+)\s+import\s", 1)
    listed = F.regexp_replace(F.regexp_replace(text, r"^\S+\s+import\s+", ""), r"^[\s(]+|[\s)]+$", "")
    names = F.filter(F.split(F.when(is_from, listed).otherwise(text), r"\s*,\s*"), lambda n: n.rlike(r"^\s*[\w.]"))
    return F.transform(names, lambda n: F.struct(
        F.concat(F.when(is_from, F.concat(mod, F.lit("."))).otherwise(""), F.regexp_extract(F.trim(n), r"^([\w.]+)", 1)).alias("module"),
        F.nullif(F.regexp_extract(n, r"\sas\s+(\w+)", 1), F.lit("")).alias("alias"), mod.startswith(".").alias("is_relative"),
    ))


def _table(files: DataFrame, found: DataFrame | None, kind: str) -> DataFrame:
    rows = (cut(parsed(files)) if found is None else found).select("repo_id", F.col("path").alias("file_path"), F.explode(kind).alias("r"))
    return rows.select("repo_id", "file_path", "r.*")


def extract_functions(files: DataFrame, found: DataFrame | None = None) -> DataFrame:
    return _table(files, found, "functions")


def extract_classes(files: DataFrame, found: DataFrame | None = None) -> DataFrame:
    return _table(files, found, "classes")


def extract_call_sites(files: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """Repeats of one target on one line are one site; calls outside any function are left out."""
    return _table(files, found, "calls").groupBy("repo_id", "file_path", "caller_qname", "callee_name", "line").agg(F.max("character").alias("character"))


def extract_imports(files: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """One row per imported name: module, alias, whether it is relative."""
    return _table(files, found, "imports").distinct()


def extract_docs(files: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """First-statement texts of Python classes and functions."""
    every = cut(parsed(files)) if found is None else found
    both = F.concat(*[F.transform(k, lambda r: F.struct("path", r["qualified_name"].alias("qualified_name"), r["doc"].alias("doc"))) for k in ("classes", "functions")])
    return every.select("repo_id", F.explode(both).alias("r")).select("repo_id", F.col("r.path").alias("file_path"), "r.qualified_name", "r.doc").filter("doc <> ''")


def ingest_stats(files: DataFrame) -> DataFrame:
    """Counters of an ingest per repo, and the languages met."""
    n = lambda df, c: df.groupBy("repo_id").agg(F.count(F.lit(1)).alias(c))
    kind = language(F.col("path"))
    seen = files.groupBy("repo_id").agg(
        F.count_if(kind.isNotNull()).alias("files_parsed"), F.count_if(kind.isNull()).alias("files_skipped"),
        F.array_join(F.sort_array(F.collect_set(file_label(F.col("path")))), ",").alias("languages"),
    )
    out = seen
    found = cut(parsed(files))
    for df, c in (
        (extract_functions(files, found), "functions"), (extract_classes(files, found), "classes"),
        (extract_call_sites(files, found), "calls"), (extract_imports(files, found), "imports"),
    ):
        out = out.join(n(df, c), "repo_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return out.select("repo_id", "files_parsed", "files_skipped", "languages", *[zero(c) for c in ("functions", "classes", "calls", "imports")])
