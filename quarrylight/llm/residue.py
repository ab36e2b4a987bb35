"""Template residue and error-page text: placeholder detectors, message detectors and host evidence.

A text is residue if it *is* such a thing somewhere, not if it talks about one: the detectors take
whole messages and unfilled slots, and leave slots that are named or quoted as such. Messages the
lists don't know are judged by evidence: a response with the marks of one (a reference number,
"try again in ...") is residue if the same skeleton (numbers, references and hosts masked) comes
back under several hosts and shares no term with the words of its own address. A short text without
any mark, in whatever wording or language, is residue on twice that evidence.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylight.functions import urls
from quarrylight.llm.quality import FUNCTION_WORDS
from quarrylight.llm.vectors import plain
from quarrylight.storage import cut

#: Words that stand in the well-known filler passage and in no other language (fixed values), and endings of Latin words.
LATIN = ("lorem", "ipsum", "dolor", "dolorem", "dolore", "amet", "consectetur", "adipiscing", "eiusmod", "incididunt", "aliqua", "veniam", "nostrud", "ullamco", "laboris", "aliquip",
         "consequat", "aute", "irure", "reprehenderit", "voluptate", "cillum", "fugiat", "pariatur", "excepteur", "occaecat", "cupidatat", "proident", "deserunt", "mollit", "laborum")
_ENDING = r"(?:us|um|is|it|at|et|or|ae|am|em|im|os|as|nt|ur|ut|ix|en|ed|a|o|e)"
_LATIN = r"(?:(?!(?:" + "|".join(sorted(FUNCTION_WORDS - {"sed", "se"})) + rf")\b)[a-z]+{_ENDING}\b)"
#: Filler: five words or more that all end as Latin ones do, no function word of a living language among them, and one of the passage.
FILLER = rf"\b(?=(?:{_LATIN}[ .,;]+){{0,16}}(?:{'|'.join(LATIN)})\b)(?:{_LATIN}[ .,;]+){{4,}}{_LATIN}"

#: What stands before and after a slot that is only talked about.
_QUOTE = r"(?<!['\"‘“`])"
_TALK = r"(?!['\"’”`]|\s*(?:braces|brackets|syntax|tags?|notation|tokens?|markers?|placeholders?)\b)"
_NAME = r"(?=[\w.:|-]*[a-z])\w[\w.:|-]*"
_REASON = (r"(?:(?:page )?not found|forbidden|gone|bad gateway|bad request|unauthorized|internal server (?:error|fault)|service unavailable|gateway time-?out|access denied|method not allowed|"
           r"too many requests|request timeout)")
_SERVER = r"(?:nginx|openresty|httpd|apache|iis|caddy|lighttpd|cloudflare|varnish|tomcat)"
_FRAME = r"(?<=\b(?:hello|dear|welcome to|copyright|open since|by|for|from|thanks to) )"

#: A bracket that opens with a function word is an aside, no slot.
_NO_FUNCTION_WORD = r"(?!(?:" + "|".join(sorted(FUNCTION_WORDS - {"your", "my", "our", "their"})) + r")\b)"

#: (class, literals one of which the text must have, pattern), over the lower-cased text with single blanks.
#: The literal is looked for first: it costs a fraction of the pattern and is absent from nearly all texts.
DETECTORS = (
    # unfilled slots, and empty values printed in their place
    ("placeholder", ("{{",), _QUOTE + r"\{\{\{?\s*" + _NAME + r"\s*\}?\}\}" + _TALK),
    ("placeholder", ("{%",), r"\{%%?\s*[a-z][^%{}]{0,60}%%?\}" + _TALK),
    ("placeholder", ("<%",), r"<%=?\s*[a-z][^%<>]{0,60}%>" + _TALK),
    ("placeholder", ("${", "#{", "{$"), r"(?:[$#]\{|\{\$)[a-z][\w.]*\}" + _TALK),
    ("placeholder", ("%(",), r"%\([a-z]\w*\)[sdif]\b" + _TALK),
    ("placeholder", ("*|",), r"\*\|" + _NAME + r"\|\*" + _TALK),
    ("placeholder", ("<<",), r"<<\s*[a-z]\w*(?:[-_ ]\w+)*\s*>>" + _TALK),
    ("placeholder", ("@@", "%%"), r"(?:@@[a-z]\w*@@|%%[a-z]\w*%%)" + _TALK),
    ("placeholder", ("__",), r"(?<!\w)__[a-z]+(?:_[a-z]+)*__(?!\w)" + _TALK),
    ("placeholder", ("[[",), r"\[\[\s*[a-z]\w*(?:[:._ -]\w+)*\s*\]\]" + _TALK),
    ("placeholder", ("{",), r"(?<![\w(){}\]])\{\d\}(?![\w(){}\[])" + _TALK),
    ("placeholder", ("todo_",), r"\btodo_[a-z]+(?:_[a-z]+)*\b" + _TALK),
    ("placeholder", ("xx/xx", "xx.xx", "xx-xx", "dd/mm/yyyy"), r"\b(?:xx[/.-]xx[/.-]xx(?:xx)?|dd/mm/yyyy)\b" + _TALK),
    ("placeholder", ("[insert", "[your", "[enter", "[add ", "[type ", "[put "), _QUOTE + r"\[(?:insert|your|enter|add|type|put)\b[^\[\]]{1,60}\]" + _TALK),
    ("placeholder", ("einsetzen]", "eintragen]", " here]", "insérer]", "insertar]"), _QUOTE + r"\[[^\[\]]{1,40} (?:einsetzen|eintragen|here|insérer|insertar)\]" + _TALK),
    ("placeholder", ("<insert", "<your", "<enter"), r"<(?:insert|your|enter) [\w ]{1,40}>" + _TALK),
    ("placeholder", (":",), r"(?<![\w:]):[a-z]+_[a-z_]+:(?![\w:])" + _TALK),
    ("placeholder", ("[", "{", "<"), r"\b(?:hello|hi|dear|welcome|thanks|thank you|regards|sincerely|by|from|for|to)[ ,:]+(?:\[(?!at\]|dot\])" + _NO_FUNCTION_WORD + r"[a-z]+(?:[ _-][a-z]+){0,3}\]|\{[a-z]+(?:[ _-][a-z]+){0,3}\}|<[a-z]+(?:[ _-][a-z]+){1,3}>)" + _TALK),
    ("placeholder", ("{",), _QUOTE + r"(?<![\w(){}\]$#%])\{[a-z]+(?:_[a-z]+)+\}(?![\w(){}\[])" + _TALK),
    ("placeholder", ("name here",), _QUOTE + r"\byour (?:company )?name here\b" + _TALK),
    ("placeholder", ("[object",), r"\[object object\]" + _TALK),
    ("placeholder", ("undefined", "null", "nan", "none"), _FRAME + r"(?:undefined|null|nan|none)(?=[,:.;!]| (?:\w+ly|is|was) )"),
    ("placeholder", ("hello ,", "dear ,", "copyright ,", "welcome to ,"), r"\b(?:hello|dear|copyright|welcome to) ,(?= \w)"),
    # filler
    ("filler", ("lorem", "ipsum", "dolor", "amet", "consectetur", "adipiscing", "eiusmod"), FILLER),
    ("filler", ("sample text",), r"\bsample text (?:for|about)\b"),
    ("filler", ("placeholder",), r"\bplaceholder (?:headline|text|copy|title|paragraph)\b"),
    ("filler", ("dummy ",), r"\bdummy (?:copy|text),"),
    ("filler", ("blindtext",), r"\bblindtext\b"),
    ("filler", ("in this ",), r"\badd an? (?:short )?(?:description|summary|bio) of .{1,80} in this (?:box|field)"),
    ("filler", ("goes here",), r"\b(?:text|content) about .{1,80} goes here|(?<!['\"])\b(?:text|content|title|copy|headline) goes here\b"),
    ("filler", (" about ",), r"\byour (?:sub)?(?:heading|headline|title|text|slogan) about .{1,80} here\b"),
    ("filler", ("coming soon",), r"\bcontent for .{1,80} coming soon"),
    ("filler", ("hier steht", "ici bient", "aquí ", "asdf asdf"), r"\bhier steht bald\b|\bici bient[oô]t\b|\baquí (?:va|irá|pronto) |\basdf asdf\b"),
    # messages of servers and gates
    ("error_page", ("nginx", "openresty", "httpd", "apache", "iis", "caddy", "lighttpd", "cloudflare", "varnish", "tomcat"), rf"\b[45]\d\d {_REASON} {_SERVER}\b"),
    ("error_page", ("error 4", "error 5"), rf"\berror [45]\d\d: (?:{_REASON}|[^.]{{1,60}}\(ref )"),
    ("error_page", ("40", "50", "41", "42"), rf"^\W*(?:http |error |status |code )*[45]\d\d\b[ :.,–—-]*(?:error[ :–—-]+)?{_REASON}\b"),
    ("error_page", (" found", " exist", "located"), r"(?:^|[.!?:] )(?:oops|sorry|uh-oh|whoops)?[!,.]* ?(?:that|this|the) (?:requested )?(?:page|resource|address|url|file|document)(?: you (?:requested|asked for|were looking for|are looking for))? (?:could not be|can(?:not|['’]t) be|was not|is not|does not|doesn['’]t|no longer|isn['’]t) ?(?:found|located|exists?)\b"),
    ("error_page", ("the page you ",), r"\b[45]\d\d [-–—] the page you "),
    ("error_page", ("database",), r"\bcould not connect to the database\b|\berror establishing a database connection"),
    ("error_page", ("suspended",), r"\baccount (?:has been )?suspended\. contact"),
    ("error_page", ("upstream sent", "maintenance"), r"\bupstream sent no answer|\bis down for maintenance\b"),
    ("error_page", ("nicht gefunden", "introuvable", "no encontrada", "no se encuentra"), r"\bno se encuentra la página \(|\bseite (?:wurde )?nicht gefunden \(|\bpage introuvable sur\b|\bpágina no encontrada\b"),
    ("error_page", ("your browser",), r"\bchecking your browser before\b"),
    ("error_page", (" denied",), r"\baccess to [\w.:-]+ (?:was|is|has been) denied\b"),
    ("error_page", ("took too long",), r"\bthe server at [\w.:-]+ took too long\b"),
    ("error_page", ("find that page",), r"\bwe can['’]?t find that page\b"),
    ("error_page", ("fatal error", "uncaught", "traceback"), r"\bfatal error: (?:uncaught|allowed|call|maximum)|\buncaught \w*(?:error|exception) in /|\btraceback \(most recent call last\)"),
    ("error_page", ("failed to open stream", "parse error", "syntax error"), r"\b(?:warning|fatal error): (?:include|require|fopen|file_get_contents)[\w]*\(.{0,80}failed to open stream|\b(?:parse|syntax) error: .{1,80} on line \d"),
    ("error_page", ("been logged", "on this server"), r"\byour request \w+ has been logged\b|\bthe requested url .{1,60} was not found on this server"),
    # scripts required
    ("script_notice", ("javascript", "scripts", "java script"), r"\b(?:enable|activate|activer|activez|activa|active|allow|permit|turn on) (?:java ?script|scripts)\b(?! (?:error|file))"),
    ("script_notice", ("javascript", "java script"), r"\bjava ?script (?:aktivieren|einschalten|is (?:disabled|off|turned off|switched off|required|needed|not enabled))|\b(?:needs|requires) java ?script\b|\bwithout (?:js|java ?script) enabled\b"),
    ("script_notice", ("js enabled", "scripting", "scripts ", "noscript"), r"\bwithout js enabled\b|\bscripting (?:is )?(?:switched|turned) off\b|\bscripts (?:and cookies )?are required\b|\bnoscript:"),
    # marks of a machine's answer
    ("weak", ("incident ", "trace ", "(ref ", "request "), r"\b(?:incident|trace|request) [0-9a-f]{6,}|\(ref [0-9a-f]{6,}\)"),
    ("weak", ("again in ", "reload the page", "go back home"), r"\btry again in \d+ (?:minutes|seconds)|\breload the page\b|\bgo back home\b"),
)
#: Characters a text without marks may have, and words of letters its skeleton must have, to be judged by hosts and addresses alone.
SHORT, WORDS = 200, 3
CLASSES = ("placeholder", "filler", "error_page", "script_notice", "weak")


#: Patterns, instead of their literals, of the detectors whose literals are frequent in ordinary text.
_RARER = {
    (":",): r":[a-z]+_[a-z_]+:", ("{",): r"\{\d\}|\{[a-z]+_[a-z_]+\}", ("[", "{", "<"): r"(?:hello|hi|dear|welcome|thanks|thank you|regards|sincerely|by|from|for|to)[ ,:]+[\[{<][a-z]",
    ("40", "50", "41", "42"): rf"^\W*(?:http |error |status |code )*[45]\d\d\b[ :.,–—-]*(?:error[ :–—-]+)?{_REASON}", (" found", " exist", "located"): r"(?:page|resource|address|url|file|document)(?: you [a-z ]{1,20})? (?:could not|can(?:not|['’]t)|was not|is not|does not|doesn['’]t|no longer|isn['’]t)", (" about ",): r"(?:heading|headline|title|text|slogan) about ", ("in this ",): r"in this (?:box|field)",
    ("undefined", "null", "nan", "none"): r"(?:hello|dear|welcome to|copyright|open since|by|for|from|thanks to) (?:undefined|null|nan|none)",
    ("incident ", "trace ", "(ref ", "request "): r"(?:incident|trace|request|\(ref) [0-9a-f]{6}",
}
#: One automaton over all of them: a single pass over each text leaves few texts for the patterns.
NEAR = "|".join(_RARER.get(x) or "|".join(map(re.escape, x)) for x in dict.fromkeys(d[1] for d in DETECTORS))


@lru_cache(maxsize=1)
def _compiled() -> tuple:
    frame = r"\b(?:hello|dear|welcome to|copyright|open since|by|for|from|thanks to) "
    return tuple((kind, literals, re.compile(pattern.replace(_FRAME, frame))) for kind, literals, pattern in DETECTORS)


def detect(text: str) -> set[str]:
    """Classes of marks in a flat text (lower case, single blanks)."""
    out: set[str] = set()
    for kind, literals, pattern in _compiled():
        if kind not in out and any(x in text for x in literals) and pattern.search(text):
            out.add(kind)
    return out


def _marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        flat = pc.replace_substring_regex(pc.utf8_lower(plain(b.column(1))), r"\s+", " ")
        near = pc.match_substring_regex(flat, NEAR).to_numpy(zero_copy_only=False)
        short = pc.less_equal(pc.utf8_length(flat), SHORT).to_numpy(zero_copy_only=False)
        rows = np.flatnonzero(near | short)
        found = [detect(t) if n else set() for n, t in zip(near[rows].tolist(), flat.take(pa.array(rows)).to_pylist())]
        keep = [k for k, f in enumerate(found) if f or short[rows[k]]]
        part = b.take(pa.array(rows[keep]))
        yield pa.RecordBatch.from_arrays([*part.columns, *(pa.array([c in found[k] for k in keep], pa.bool_()) for c in CLASSES)], names=["n", "t", "u", "h", *CLASSES])


def marked(df: DataFrame) -> DataFrame:
    """Rows (n, t, u, h) with any mark, or short enough to be judged without, and a boolean for each class."""
    return df.select("n", "t", "u", "h").mapInArrow(_marks, df.select("n", "t", "u", "h").schema.simpleString()[7:-1] + "".join(f",{c}:boolean" for c in CLASSES))


def skeleton(text: Column) -> Column:
    """A text with numbers, references and hosts masked, in lower case and single blanks."""
    t = F.regexp_replace(F.lower(text), r"\b[a-z0-9-]+(?:\.[a-z0-9-]+)*\.[a-z]{2,}\b", "<host>")
    t = F.regexp_replace(t, r"\b(?=[0-9a-f]*\d)[0-9a-f]{6,}\b|\d+", "<n>")
    return F.trim(F.regexp_replace(t, r"\s+", " "))


def slug_terms(url: Column) -> Column:
    """Words of three letters or more in the path of an address: what its page should be about."""
    return F.filter(F.split(F.lower(urls.raw_path(F.coalesce(url, F.lit("")))), r"[^\p{L}]+"), lambda w: F.length(w) >= 3)


def judged(df: DataFrame, number: str = "find_id", text: str = "text", url: str = "url", host: str = "domain", hosts: int = 3) -> DataFrame:
    """(number, placeholder, filler, error_page, script_notice, repeated_response) of the texts that are residue.

    NULL and empty texts have none. A weak mark counts where its skeleton stands under ``hosts``
    hosts or more and no word of the own address is in the text. A short text without marks counts
    where its skeleton stands under twice as many hosts whose addresses have words, none of them in
    the text, and under at most a ninth as many where one is. Hosts are counted exactly, by 128
    hash bits of the skeletons; each host of a skeleton is one row before they are met.
    """
    base = df.where(F.col(number).isNotNull() & F.col(text).isNotNull()).select(
        F.col(number).alias("n"), F.col(text).alias("t"), F.col(url).alias("u"), urls.clean_host(F.col(host)).alias("h"))
    strong = F.col("placeholder") | F.col("filler") | F.col("error_page") | F.col("script_notice")
    terms = slug_terms(F.col("u"))
    # no texts: written once, so that the readers below don't each scan the table
    kept = marked(base).withColumn("strong", strong).withColumn("s", F.when(~F.col("strong"), skeleton(F.col("t"))))
    worded = F.size(F.filter(F.split("s", r"[^\p{L}<>]+"), lambda w: w.rlike(r"^\p{L}{2,}$"))) >= WORDS
    kept = cut(kept.where(F.col("strong") | F.col("weak") | worded).select(
        "n", "placeholder", "filler", "error_page", "script_notice", "strong", "weak", "h", F.xxhash64("s").alias("s"), F.xxhash64(F.lit(1), "s").alias("z"),
        (F.size(terms) > 0).alias("slugged"), F.exists(terms, lambda w: F.contains(F.lower(F.col("t")), w)).alias("on_topic")), "residue-marks")
    sure = kept.where("strong").withColumn("repeated_response", F.lit(False))
    rest = kept.where("NOT strong")
    each = rest.where("h IS NOT NULL").groupBy("s", "z", "weak", "h").agg(F.bool_or("on_topic").alias("on"), F.bool_or("slugged").alias("told"))
    spread = each.groupBy("s", "z", "weak").agg(F.count(F.lit(1)).alias("all"), F.count_if("on").alias("on"), F.count_if(F.col("told") & ~F.col("on")).alias("off"))
    spread = spread.where((F.col("weak") & (F.col("all") >= hosts)) | (~F.col("weak") & (F.col("off") >= 2 * hosts) & (F.col("on") * 9 <= F.col("off"))))
    rest = rest.where("NOT on_topic").join(spread, ["s", "z", "weak"], "left_semi").withColumn("repeated_response", F.lit(True))
    cols = [F.col("n").alias(number), "placeholder", "filler", "error_page", "script_notice", "repeated_response"]
    return sure.select(*cols).unionByName(rest.select(*cols)).dropDuplicates([number])


def without_residue(df: DataFrame, number: str = "find_id", **names: str) -> DataFrame:
    """``df`` without the rows that hold residue."""
    return df.join(judged(df, number, **names).select(number), number, "left_anti")
