"""Declarations of JavaScript, TypeScript, Java, C++ and Go sources in native columns, without a parser.

A source becomes its tokens, one row each; prefix sums over a file's tokens give line, place and bracket depth. Brackets
of one depth alternate between opening and closing, so the next one at a bracket's depth is its partner. The tokens then
go back to one array, in which every bracket knows its partner and every token the start of its statement, what encloses
it and where its expression stops; a declaration is a pattern of tokens at one depth. A long source is first cut into
sections where a statement outside all brackets ends with its line, so that no group of rows and no array grows with a
file; only a statement without such an end, a large class for one, stays whole.

What counts as a declaration and how it is named follows syntax trees of these languages: functions whose name is no
plain identifier next to their body (of C++, methods of Go, most arrow functions) are <anonymous>, and so are Go's types.
Template literals, comments and strings are one token each. Preprocessor branches are all read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.text import let, split_lines, strip
from lodestone.operators.symbols import SCHEMA, analyze, analyze_parts

LANGUAGES = ("javascript", "typescript", "java", "cpp", "go")
ANONYMOUS = "<anonymous>"

_STRINGS = r"""`[^`\\]*+(?:\\.[^`\\]*+)*+`?|"[^"\\\n]*+(?:\\.[^"\\\n]*+)*+"?|'[^'\\\n]*+(?:\\.[^'\\\n]*+)*+'?"""
_REST = r"[\p{L}_$][\p{L}\p{N}_$]*+|\p{N}[\p{L}\p{N}_.]*+|=>|:=|::|\n|[^\S\n]++|."
_REGEX = r"(?<=[=(,:\[!&|?{};]\s{0,4})/(?![/*])[^/\\\n]*+(?:\\.[^/\\\n]*+)*+/[a-z]*|"
TOKENS = rf"(?s)/\*.*?(?:\*/|\z)|//[^\n]*+|{_STRINGS}|{_REST}"
SCRIPT_TOKENS = TOKENS.replace("(?s)", "(?s)" + _REGEX)
CPP_TOKENS = TOKENS.replace("(?s)", r"(?s)(?<![^\n])[ \t]*#(?:[^\n\\]|\\.)*+|")

# Words that are no names of what stands after them, or before an opening parenthesis.
CONTROL = "if for while switch catch with return function do else try throw new delete typeof await yield case in of sizeof synchronized assert super this alignas decltype static_assert using typedef goto break continue import package namespace default instanceof extends implements throws operator".split()
MODIFIERS = "public private protected static final abstract native synchronized strictfp transient volatile default async get set readonly override export declare virtual inline constexpr explicit friend extern const mutable sealed".split()
BASE_WORDS = ["public", "private", "protected", "virtual"]

SECTION = 1 << 14  # characters after which a source is cut where it can be
# The end of a line after which a statement may start, if what stands before it ends one.
_LINE = r"(?<=[;}][^\S\n]{0,8})\n(?=[A-Za-z_$#@])"
_SCRIPT_LINE = r"(?<=;[^\S\n]{0,8})\n(?=[A-Za-z_$#@])|(?<=\}[^\S\n]{0,8})\n(?!(?:instanceof|in|of|as|extends|implements)(?![\p{L}\p{N}_$]))(?=[A-Za-z_$])"


def tokens(language: Column, code: Column) -> Column:
    every = lambda pattern: F.regexp_extract_all(code, F.lit(pattern), F.lit(0))
    return F.when(language == "cpp", every(CPP_TOKENS)).when(language.isin("javascript", "typescript"), every(SCRIPT_TOKENS)).otherwise(every(TOKENS))


def _trivia(tok: Column) -> Column:
    return tok.rlike(r"^(\s|//|/\*)") & ~tok.rlike(r"^\s*#")


def _word(tok: Column) -> Column:
    return tok.rlike(r"^[\p{L}_$]")


def sections(files: DataFrame, file: str, size: int = SECTION) -> DataFrame:
    """(file, section, language, before, code) of files (file, language, code): the sections of each in order of their
    numbers, which have gaps, with the lines before them. A section ends with a line, at a ; or } outside all brackets and
    before a line that starts a statement, so that no token, bracket or statement reaches over its end.

    Lines that may end one are told by their last sign alone, so what stands between two of them is tokenised by itself: a
    comment or template that is open at its end spoils all that follows in the file, which then is one section."""
    cuts = F.when(F.col("language").isin("javascript", "typescript", "go"), F.split("code", _SCRIPT_LINE)).otherwise(F.split("code", _LINE))
    rows = files.select(file, "language", F.posexplode(cuts).alias("at", "text"))
    toks = tokens(F.col("language"), F.col("text"))
    solid = lambda a: F.filter(a, lambda t: ~_trivia(t))
    many = lambda a, *signs: F.size(F.filter(a, lambda t: t.isin(*signs)))
    last = lambda a: F.get(a, F.size(a) - 1)
    open_ = lambda t: (F.startswith(t, F.lit("`")) & ~t.rlike(r"(?s)^`[^`\\]*+(?:\\.[^`\\]*+)*+`$")) | (F.startswith(t, F.lit("/*")) & ~t.rlike(r"(?s)^/\*.*\*/$"))
    facts = let(toks, lambda a: F.struct((many(a, "(", "[", "{") - many(a, ")", "]", "}")).alias("deeper"), F.coalesce(open_(last(a)), F.lit(False)).alias("open"), F.coalesce(last(solid(a)).isin(";", "}"), F.lit(False)).alias("ends")))
    rows = rows.withColumn("facts", facts).select(file, "language", "at", "text", "facts.*")
    order = Window.partitionBy(file).orderBy("at")
    so_far, before = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(Window.unboundedPreceding, -1)
    lines = F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1
    fine = F.col("ends") & (F.sum("deeper").over(so_far) == 0) & ~F.max("open").over(so_far)
    rows = rows.withColumns({"fine": fine, "before": F.coalesce(F.sum(lines).over(before), F.lit(0)), "off": F.coalesce(F.sum(F.length("text") + 1).over(before), F.lit(0))})
    starts = F.col("at").eqNullSafe(0) | F.lag("fine").over(order)
    rows = rows.withColumn("section", F.floor(F.last(F.when(starts, F.col("off")), True).over(order) / size).cast("int"))
    whole = rows.groupBy(file, "section", "language").agg(F.min("before").cast("int").alias("before"), F.array_sort(F.collect_list(F.struct("at", "text"))).alias("rows"))
    return whole.select(file, "section", "language", "before", F.array_join(F.transform("rows", lambda x: x["text"]), "\n").alias("code"))


def token_arrays(files: DataFrame, file: str, *more: str) -> DataFrame:
    """(file, T) of files (file, language, code), or of sections, which more columns tell apart: T holds (i, tok, line, off, depth, partner, body, outer, stmt, stop, semi)
    of each token that is no space or comment, in order. Numbers of tokens are places in T; depth is the number of
    brackets open before a token, partner the other bracket, body the first token of a block that follows the group that
    an opening bracket starts, outer the bracket around a token, stmt the first token of its statement, stop where an
    expression that holds it ends, semi the next semicolon."""
    place = Window.partitionBy(file, *more).orderBy("pos")
    before = place.rowsBetween(Window.unboundedPreceding, -1)
    rows = files.select(file, *more, "language", F.posexplode(tokens(F.col("language"), F.col("code"))).alias("pos", "tok"))
    newlines = F.length("tok") - F.length(F.replace("tok", F.lit("\n"), F.lit("")))
    rows = rows.withColumns({"line": F.coalesce(F.sum(newlines).over(before), F.lit(0)) + 1, "off": F.coalesce(F.sum(F.length("tok")).over(before), F.lit(0))})
    tok = F.col("tok")
    rows = rows.where(~_trivia(tok))

    opens, closes = tok.isin("(", "[", "{"), tok.isin(")", "]", "}")
    rows = rows.withColumns({"i": F.row_number().over(place) - 1, "was": F.lag("tok").over(place), "was_line": F.lag("line").over(place), "depth": F.coalesce(F.sum(F.when(opens, 1).when(closes, -1).otherwise(0)).over(before), F.lit(0)), "semis": F.count_if(tok == ";").over(before)})
    # a line that starts with a word, after what can end a statement, starts one where semicolons may be left out
    fresh = F.col("language").isin("javascript", "typescript", "go") & (F.col("line") > F.col("was_line")) & _word(tok) & ~tok.isin("instanceof", "in", "of", "as", "extends", "implements") & F.col("was").rlike(r"""^[\p{L}\p{N}_$"'`)\]}]""") & ~F.col("was").isin("return", "const", "let", "var", "async", "else", "do", "extends", "export", "default", "import", "from")
    begins = F.col("was").isNull() | F.col("was").isin(";", "{", "}") | (F.startswith("was", F.lit("#")) & (F.col("language") == "cpp")) | fresh
    place = Window.partitionBy(file, *more).orderBy("i")
    back = Window.partitionBy(file, *more).orderBy(F.col("i").desc()).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns({"stmt": F.last(F.when(begins, F.col("i")), True).over(place), "semi": F.last(F.when(tok == ";", F.col("i")), True).over(back), "fresh": fresh})

    level = F.col("depth") - F.when(closes, 1).otherwise(0)
    same = Window.partitionBy(file, *more, "bracket", "level").orderBy("i")
    rows = rows.withColumns({"bracket": opens | closes, "level": level})
    next_ = lambda c, n: F.lead(c, n).over(same)
    partner = F.when(opens, next_("i", 1)).when(closes, F.lag("i").over(same))
    body = F.when(opens & (next_("tok", 2) == "{") & (next_("semis", 2) == next_("semis", 1)), next_("i", 2))
    rows = rows.withColumns({"partner": partner, "body": body})
    # a token stops, at its depth, at the next of these, or where the bracket around it closes
    ends = Window.partitionBy(file, *more, "depth").orderBy(F.col("i").desc()).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("stop", F.last(F.when(tok.isin(",", ";") | closes | F.col("fresh"), F.col("i")), True).over(ends))
    # opening brackets stand twice: once where they are, once as the outer bracket of what is one deeper
    twice = rows.select("*", F.explode(F.when(opens, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("as_outer")).withColumn("inside", F.col("depth") + F.col("as_outer"))
    around = Window.partitionBy(file, *more, "inside").orderBy("i")
    rows = twice.withColumn("outer", F.last(F.when(F.col("as_outer") == 1, F.col("i")), True).over(around)).where("as_outer = 0")
    item = F.struct(*[F.col(c).cast("string" if c == "tok" else "int").alias(c) for c in ("i", "tok", "line", "off", "depth", "partner", "body", "outer", "stmt", "stop", "semi")])
    return rows.groupBy(file, *more).agg(F.array_sort(F.collect_list(item)).alias("T"))


class _File:
    """Expressions over one file's tokens."""

    def __init__(self, T: Column, language: Column, code: Column) -> None:
        self.T, self.language, self.code = T, language, code

    def at(self, i: Column) -> Column:
        return F.get(self.T, i)

    def tok(self, i: Column) -> Column:
        return F.coalesce(self.at(i)["tok"], F.lit(""))

    def line(self, i: Column) -> Column:
        return self.at(i)["line"]

    def text(self, start: Column, last: Column) -> Column:
        """The source from one token to another, both included."""
        a, z = self.at(start)["off"], self.at(last)["off"] + F.length(self.tok(last))
        return F.substring(self.code, a + 1, z - a)

    def within(self, start: Column, end: Column) -> Column:
        """Tokens from start on, up to end, which does not belong."""
        return F.slice(self.T, start + 1, F.greatest(end - start, F.lit(0)))

    def script(self) -> Column:
        return self.language.isin("javascript", "typescript")

    def name(self, i: Column) -> Column:
        return _word(self.tok(i)) & ~self.tok(i).isin(CONTROL)

    def parameters(self, opening: Column) -> Column:
        """Names in a group of parameters: in each, those that are plain identifiers of the language's grammar."""
        close, depth = self.at(opening)["partner"], self.at(opening)["depth"] + 1
        inner = F.filter(self.within(opening + 1, close), lambda x: x["depth"] == depth)
        tok, lang = self.tok, self.language

        def wanted(x: Column) -> Column:
            was, after, i = tok(x["i"] - 1), tok(x["i"] + 1), x["i"]
            first = (was == "(") | (was == ",")
            typed = first | was.isin(MODIFIERS)
            plain = _word(x["tok"]) & ~x["tok"].isin(CONTROL)
            # of Go's names before one type the first: the name before it, if any, has a type of its own
            alone = (after == ",") | (after == ")")
            led = first & ~((was == ",") & _word(tok(i - 2)) & tok(i - 3).isin("(", ","))
            some_type = F.exists(inner, lambda y: _word(y["tok"]) & tok(y["i"] - 1).isin("(", ",") & ~tok(y["i"] + 1).isin(",", ")", "."))
            return plain & (
                F.when(lang == "javascript", first & alone).when(lang == "typescript", typed & after.isin(":", "?", ",", ")", "="))
                .when(lang == "java", alone & ((_word(was) & ~was.isin("final")) | was.isin(">", "]"))).when(lang == "go", led & some_type & (after != ".")).otherwise(False)
            )

        return F.transform(F.filter(inner, wanted), lambda x: x["tok"])

    def functions(self) -> Column:
        tok, at, name, lang = self.tok, self.at, self.name, self.language
        here = lambda x: (x["i"], x["tok"], tok(x["i"] - 1), tok(x["i"] + 1))
        anonymous = F.lit(ANONYMOUS)
        none = F.array().cast("array<string>")
        made = lambda start, last, label, args: F.struct(start.alias("start"), last.alias("last"), label.alias("name"), args.alias("args"))

        def keyword(x: Column) -> Column:
            """function and func."""
            i, t, was, after = here(x)
            start = F.when(was == "async", i - 1).otherwise(i)
            group = F.get(F.filter(F.slice(self.T, i + 3, F.lit(40)), lambda y: (y["depth"] == x["depth"]) & (y["tok"] == "(")), F.lit(0))["i"]  # after type parameters
            stands = (at(i)["stmt"] == start) | tok(start - 1).isin("export", "default", ")")
            script = self.script() & (t == "function") & name(i + 1) & (tok(group) == "(") & at(group)["body"].isNotNull() & stands
            go = (lang == "go") & (t == "func") & name(i + 1) & (tok(group) == "(")
            receiver = at(i + 1)["partner"]
            method = (lang == "go") & (t == "func") & (x["depth"] == 0) & (after == "(") & _word(tok(receiver + 1)) & (tok(receiver + 2) == "(")
            results = lambda g: at(g)["partner"] + 1  # noqa: E731  Go's results may be a group of their own
            end = lambda g: F.coalesce(at(at(g)["body"])["partner"], F.when(tok(results(g)) == "(", at(at(results(g))["body"])["partner"]), at(g)["partner"])
            return F.when(script | go, made(start, end(group), tok(i + 1), self.parameters(group))).when(method, made(i, end(receiver + 2), anonymous, self.parameters(i + 1)))

        def arrow(x: Column) -> Column:
            i, t, was, after = here(x)
            typed = F.filter(F.slice(self.T, F.greatest(i - 30, F.lit(1)), F.lit(30)), lambda y: (y["i"] < i) & (y["depth"] == x["depth"] + 1) & (y["tok"] == ")") & (tok(y["i"] + 1) == ":"))
            close = F.when(was == ")", i - 1).when(lang == "typescript", F.get(typed, F.size(typed) - 1)["i"])
            bare = close.isNull() & _word(was)
            opening = at(close)["partner"]
            first = F.coalesce(opening, i - 1)
            start = F.when(tok(first - 1) == "async", first - 1).otherwise(first)
            stop = at(i)["stop"]
            single = name(i + 1) & (~tok(i + 1).isin("true", "false", "null", "undefined", "async")) & (stop == i + 2)
            label = F.when(bare, was).when(single, after).otherwise(anonymous)
            last = F.when(after == "{", at(i + 1)["partner"]).otherwise(F.coalesce(stop, F.size(self.T)) - 1)
            return F.when(self.script() & (t == "=>"), made(start, last, label, F.when(opening.isNotNull(), self.parameters(opening)).otherwise(none)))

        def group(x: Column) -> Column:
            """A name, parameters and a body: methods, constructors, functions of C++."""
            i, t, was, after = here(x)
            opening, body = i + 1, at(i + 1)["body"]
            header = (after == "(") & _word(t) & ~t.isin(CONTROL)
            last = at(body)["partner"]
            alone = F.coalesce(x["line"] > at(i - 1)["line"], F.lit(True))
            script = self.script() & body.isNotNull() & (was.isin("{", "}", ",", ";", "async", "get", "set", "static", "*", *MODIFIERS) | alone) & (was != "function") & (tok(at(opening)["partner"] + 1).isin("{", ":"))
            start = F.when((was == "*") | was.isin(MODIFIERS), F.greatest(at(i)["stmt"], at(at(i)["outer"])["i"] + 1)).otherwise(i)
            ends = F.coalesce(last, at(i)["semi"])
            typed = (_word(was) & ~was.isin(CONTROL) & ~was.isin(MODIFIERS)) | was.isin(">", "]")
            method = (lang == "java") & typed & ((body.isNotNull()) | (tok(at(opening)["partner"] + 1) == ";"))
            built = (lang == "java") & body.isNotNull() & ((was == "") | was.isin("{", "}", ";", *MODIFIERS))
            cpp = (lang == "cpp") & body.isNotNull()
            return F.when(header, F.when(script, made(start, last, t, self.parameters(opening))).when(method | built, made(at(i)["stmt"], ends, t, self.parameters(opening))).when(cpp, made(at(i)["stmt"], last, anonymous, none)))

        found = F.transform(self.T, lambda x: F.coalesce(keyword(x), arrow(x), group(x)))
        ordered = F.array_sort(F.filter(found, lambda f: f.isNotNull()))
        return F.transform(ordered, lambda f: F.struct(
            f["name"].alias("name"), f["args"].alias("args"), none.alias("decorators"), F.lit(None).cast("string").alias("return_annotation"), F.lit(None).cast("string").alias("docstring"),
            self.line(f["start"]).alias("start_line"), self.line(f["last"]).alias("end_line"), (self.line(f["last"]) - self.line(f["start"]) + 1).alias("line_count"), F.lit(False).alias("is_method"), F.lit(False).alias("is_async"), F.lit(0).alias("complexity"),
        ))

    def _methods(self, body: Column) -> Column:
        """Names of methods right in a class body, constructors only where a method's syntax makes them."""
        tok, at = self.tok, self.at

        def is_method(x: Column) -> Column:
            was, opening = tok(x["i"] - 1), x["i"] + 1
            typed = (_word(was) & ~was.isin(CONTROL) & ~was.isin(MODIFIERS)) | was.isin(">", "]")
            block = at(opening)["body"].isNotNull()
            java = (self.language == "java") & typed & (block | (tok(at(opening)["partner"] + 1) == ";"))
            return _word(x["tok"]) & ~x["tok"].isin(CONTROL) & (tok(opening) == "(") & (java | (self.script() & block))

        return F.transform(F.filter(self.within(body + 1, at(body)["partner"]), lambda x: (x["outer"] == body) & is_method(x)), lambda x: x["tok"])

    def classes(self) -> Column:
        tok, at, lang = self.tok, self.at, self.language
        none = F.array().cast("array<string>")

        def body_of(i: Column) -> Column:
            """The block of a head that starts at i: the first { at its depth before anything that ends it."""
            head = F.filter(F.slice(self.T, i + 2, F.lit(40)), lambda y: (y["depth"] == at(i)["depth"]) & y["tok"].isin("{", ";", "(", ")", "="))
            return let(F.get(head, F.lit(0)), lambda y: F.when(y["tok"] == "{", y["i"]))

        def bases(x: Column, body: Column) -> Column:
            head = self.within(x["i"] + 2, body)
            plain = lambda y: _word(y["tok"]) & ~tok(y["i"] + 1).isin(".", "<", "::", "(") & ~tok(y["i"] - 1).isin(".", "<", "::")
            after = F.filter(head, lambda y: (tok(y["i"] - 1) == "extends") & plain(y))
            cpp = F.filter(head, lambda y: plain(y) & (tok(y["i"] - 1).isin(":", ",", *BASE_WORDS)) & ~y["tok"].isin(BASE_WORDS))
            return F.transform(F.when((lang == "cpp"), cpp).when((lang == "javascript") | ((lang == "java") & (x["tok"] == "class")), after).otherwise(F.slice(head, 1, 0)), lambda y: y["tok"])

        def declared(x: Column) -> Column:
            i, t, was = x["i"], x["tok"], tok(x["i"] - 1)
            start = F.when(lang == "java", x["stmt"]).otherwise(i)
            word = F.when(lang == "cpp", t.isin("class", "struct") & (was != "enum")).when(lang == "java", t.isin("class", "interface") & (was != "@") & (was != ".")).otherwise(self.script() & (t == "class") & ((x["stmt"] == i) | was.isin("export", "default")) & (was != "abstract"))
            made = let(body_of(i), lambda b: F.when(b.isNotNull(), F.struct(start.alias("start"), at(b)["partner"].alias("last"), tok(i + 1).alias("name"), bases(x, b).alias("bases"), F.when((lang == "cpp") | (t == "interface"), none).otherwise(self._methods(b)).alias("methods"))))
            named = F.when((lang == "cpp") & ~was.isin("<", ",", "friend"), F.struct(i.alias("start"), (i + 1).alias("last"), tok(i + 1).alias("name"), none.alias("bases"), none.alias("methods")))  # without a body
            grouped = F.when(tok(i + 1) == "(", at(i + 1)["partner"])
            block = F.coalesce(grouped, at(body_of(i))["partner"])
            go = (lang == "go") & (t == "type") & (x["stmt"] == i)
            line_end = F.coalesce(F.when(tok(i + 2).isin("struct", "interface") | grouped.isNotNull(), block), F.coalesce(at(i)["stop"], F.size(self.T)) - 1)
            return F.when(word & _word(tok(i + 1)), F.coalesce(made, named)).when(go, F.struct(i.alias("start"), line_end.alias("last"), F.lit(ANONYMOUS).alias("name"), none.alias("bases"), none.alias("methods")))

        found = F.filter(F.transform(self.T, declared), lambda c: c.isNotNull())
        return F.transform(found, lambda c: F.struct(
            c["name"].alias("name"), c["bases"].alias("bases"), c["methods"].alias("methods"), none.alias("decorators"), F.lit(None).cast("string").alias("docstring"),
            self.line(c["start"]).alias("start_line"), self.line(c["last"]).alias("end_line"), (self.line(c["last"]) - self.line(c["start"]) + 1).alias("line_count"),
        ))

    def imports(self) -> Column:
        tok, at, lang = self.tok, self.at, self.language
        unquoted = lambda t: F.regexp_replace(t, r"""^['"]+|['"]+$""", "")

        def made(x: Column) -> Column:
            i, t = x["i"], x["tok"]
            stated = F.get(F.filter(F.slice(self.T, i + 2, F.lit(200)), lambda y: y["tok"].rlike("^['\"]") & (y["depth"] == x["depth"]) & ((y["i"] == i + 1) | (tok(y["i"] - 1) == "from"))), F.lit(0))
            script = F.when(stated.isNotNull() & ~tok(i + 1).isin("(", "."), F.struct(unquoted(stated["tok"]).alias("module"), self.text(i, stated["i"]).alias("text")))
            last = at(i)["semi"]
            inner = F.when(tok(i + 1) == "static", i + 2).otherwise(i + 1)
            stop = F.when(tok(last - 1) == "*", last - 3).otherwise(last - 1)
            whole = self.text(i, last)
            java = F.struct(F.when(stop > inner, self.text(inner, stop)).otherwise(whole).alias("module"), whole.alias("text"))
            go_text = self.text(i, F.when(tok(i + 1) == "(", at(i + 1)["partner"]).when(tok(i + 1).rlike('^["`]'), i + 1).otherwise(i + 2))
            go = F.struct(go_text.alias("module"), go_text.alias("text"))
            line = strip(t)
            quoted = F.regexp_extract(line, '^#\\s*include\\s*"([^"]*)"', 1)
            cpp = F.struct(F.when(quoted != "", quoted).otherwise(line).alias("module"), line.alias("text"))
            word = (t == "import") & (x["stmt"] == i)
            return F.when(word & self.script(), script).when(word & (lang == "java"), java).when(word & (lang == "go"), go).when((lang == "cpp") & line.rlike(r"^#\s*include\b"), cpp)

        found = F.filter(F.transform(self.T, lambda x: F.struct(made(x).alias("m"), x["line"].alias("line"))), lambda s: s["m"].isNotNull())
        return F.transform(found, lambda s: F.struct(s["m"]["module"].alias("module"), F.array(s["m"]["module"]).alias("names"), F.lit(None).cast("string").alias("alias"), F.contains(F.lower(s["m"]["text"]), F.lit("from")).alias("is_from_import"), s["line"].alias("line")))

    def variables(self) -> Column:
        tok, at, lang = self.tok, self.at, self.language

        def made(x: Column) -> Column:
            i, t, was, after = x["i"], x["tok"], tok(x["i"] - 1), tok(x["i"] + 1)
            script = self.script() & t.isin("var", "let", "const") & ((x["stmt"] == i) | (was == "export") | ((was == "(") & (tok(i - 2) == "for"))) & ~tok(i + 2).isin("of", "in") & (tok(i + 1) != "enum") & (_word(after) | after.isin("{", "["))
            pattern = self.text(i + 1, F.coalesce(at(i + 1)["stop"], F.size(self.T)) - 1)
            own = at(x["stmt"])["depth"] == x["depth"]
            in_for = (tok(x["outer"] - 1) == "for") & (tok(x["outer"]) == "(")
            typed = (_word(was) & ~was.isin(CONTROL) & ~was.isin("class", "interface", "struct", "enum", "return")) | was.isin(">", "]")
            plain = _word(t) & ~t.isin(CONTROL) & typed & ~tok(x["stmt"]).isin("import", "package", "using", "typedef", "return", "throw", "goto", "delete", "namespace", "break", "continue")
            java = (lang == "java") & plain & (after.isin("=", ";", ",")) & (own | in_for) & ~was.isin(*[m for m in MODIFIERS])
            cpp = (lang == "cpp") & plain & after.isin(";", ",") & own & ~was.isin(MODIFIERS) & ~F.coalesce(self._of_class(x["outer"]), F.lit(False))
            label = F.when(script, F.when(_word(after), after).otherwise(pattern)).when(java | cpp, t)
            return F.struct(label.alias("name"), F.when(script, x["line"]).otherwise(self.line(x["stmt"])).alias("line"))

        found = F.filter(F.transform(self.T, made), lambda v: v["name"].isNotNull())
        upper = lambda n: (F.upper(n) == n) & (F.lower(n) != n)
        return F.transform(found, lambda v: F.struct(v["name"].alias("name"), F.lit(None).cast("string").alias("annotation"), v["line"].alias("line"), upper(v["name"]).alias("is_constant")))

    def _of_class(self, body: Column) -> Column:
        """Whether a { belongs to a class or struct: its statement starts with, or holds, the word."""
        return F.exists(self.within(self.at(body)["stmt"], body), lambda y: y["tok"].isin("class", "struct")) & (self.tok(body) == "{")


_KINDS = dict(part.strip().split(" ", 1) for part in SCHEMA.split(", "))
PARTS = ("functions", "classes", "imports", "variables")


def declared_parts(files: DataFrame, file: str = "path", size: int = SECTION) -> DataFrame:
    """(file, section, functions, classes, imports, variables) of the sections, in order, of files (file, language, code) in
    one of LANGUAGES, in the columns of symbols.analyze. Files without tokens have no rows."""
    rows = files.where(F.col("language").isin(*LANGUAGES)).select(F.col(file).cast("string").alias(file), "language", F.coalesce(F.col("code"), F.lit("")).alias("code"))
    cuts = sections(rows, file, size)
    # a merge join, as an array of tokens takes far more room than its size as Spark estimates it, by which it is broadcast
    whole = cuts.join(token_arrays(cuts, file, "section").hint("merge"), [file, "section"])
    f = _File(F.col("T"), F.col("language"), F.col("code"))

    def moved(part: Column, lines: tuple[str, ...]) -> Column:
        """Lines count from the start of the file."""
        def row(x: Column) -> Column:
            for name in lines:
                x = x.withField(name, x[name] + F.col("before"))
            return x

        return F.transform(part, row)

    found = {"functions": moved(f.functions().cast(_KINDS["functions"]), ("start_line", "end_line")), "classes": moved(f.classes().cast(_KINDS["classes"]), ("start_line", "end_line"))}
    found |= {"imports": moved(f.imports().cast(_KINDS["imports"]), ("line",)), "variables": moved(f.variables().cast(_KINDS["variables"]), ("line",))}
    return whole.select(file, "section", *[c.alias(n) for n, c in found.items()])


def declarations(files: DataFrame, file: str = "path") -> DataFrame:
    """One row for each file (file, language, code) in one of LANGUAGES, in the columns of symbols.analyze: functions,
    classes, imports and variables with their lines. A null source is empty; a file named twice must be so once only.

    Functions nest and stand in the order of their first tokens. Names of Java fields and local variables are those of a
    statement's first declarator, of C++ those that have no initialiser and stand in no class; Go gives none."""
    rows = files.where(F.col("language").isin(*LANGUAGES)).select(F.col(file).cast("string").alias(file), "language", F.size(split_lines(F.coalesce(F.col("code"), F.lit("")))).alias("total_lines"))
    none = [F.lit(None).cast(_KINDS[p]).alias(p) for p in PARTS]
    own = rows.select(file, F.lit(-1).alias("section"), "language", "total_lines", *none)
    found = declared_parts(files, file).select(file, "section", F.lit(None).cast("string").alias("language"), F.lit(None).cast("int").alias("total_lines"), *PARTS)
    # gathered with the file's own row, not joined to it: no side that could be broadcast
    whole = own.unionByName(found).groupBy(file).agg(F.max("language").alias("language"), F.max("total_lines").alias("total_lines"), F.array_sort(F.collect_list(F.struct("section", *PARTS))).alias("rows"))
    blocks = F.array().cast(_KINDS["blocks"])
    joined = [F.flatten(F.filter(F.col("rows")[p], lambda x: x.isNotNull())).alias(p) for p in PARTS]
    return whole.select(file, "language", F.lit(True).alias("valid"), F.lit(None).cast("string").alias("error"), "total_lines", *joined, blocks.alias("blocks"))


def analyze_all(files: DataFrame, file: str = "path") -> DataFrame:
    """symbols.analyze for files of all languages: python by its parser, LANGUAGES by their tokens, others not valid."""
    other = ~F.coalesce(F.col("language").isin(*LANGUAGES), F.lit(False))
    return analyze(files.where(other), file).unionByName(declarations(files, file))


def analyze_all_parts(files: DataFrame, file: str = "path") -> DataFrame:
    """analyze_all in parts, for plans that take symbols one by one: for a file in LANGUAGES its own row, with part 0 and no
    symbols, and one for each section, with parts from 1."""
    mine = F.coalesce(F.col("language").isin(*LANGUAGES), F.lit(False))
    none = [F.array().cast(_KINDS[p]).alias(p) for p in PARTS]
    own = files.where(mine).select(F.col(file).cast("string").alias(file), "language", F.lit(0).alias("part"), *none)
    found = declared_parts(files, file).select(file, F.lit("").alias("language"), (F.col("section") + 1).alias("part"), *PARTS)
    facts = [F.lit(True).alias("valid"), F.lit(None).cast("string").alias("error")]
    names = [file, "language", "part", "valid", "error", *PARTS]
    return analyze_parts(files.where(~mine), file).select(*names).unionByName(own.unionByName(found).select("*", *facts).select(*names))
