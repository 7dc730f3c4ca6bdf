"""Template residue, filler, error pages and demands for scripts in place of content.

Placeholders are found by a grammar per delimiter; each hit is weighed by its surroundings: code
marks, words of tutorials, and how much of the text the hits make up. Error messages and script
notices count only where they are the whole value, so that writing about them is no case.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treelake.operators.dedupe import latest

_NAME = r"[A-Za-z_][A-Za-z0-9_]*(?:[.\-][A-Za-z_][A-Za-z0-9_]*)*"
#: Delimiters that hardly occur in prose: any name between them is a placeholder.
_STRONG = re.compile(
    rf"\{{\{{\{{?\s*[&#/]?{_NAME}(?:\s*\|\s*{_NAME})?\s*\}}?\}}\}}|\$\{{\s*{_NAME}\s*\}}|#\{{\s*{_NAME}\s*\}}|<%[=-]?\s*{_NAME}\s*%>|&lt;%=?\s*{_NAME}\s*%&gt;"
    rf"|\[%\s*{_NAME}\s*%\]|\{{%\s*{_NAME}\s*%\}}|\*\|{_NAME}\|\*|@@{_NAME}@@|@Model\.{_NAME}|(?<!\w)__[A-Za-z]\w*(?:\.\w+)*__(?!\w)|%%{_NAME}%%|\[\[{_NAME}\]\]"
)
#: Delimiters of prose, too: the name must look like a variable's.
_WEAK = re.compile(rf"\{{({_NAME})\}}|\[({_NAME})\]|(?:<|&lt;)({_NAME})(?:>|&gt;)|«\s?({_NAME})\s?»|~({_NAME})~|(?<![\w%])%({_NAME})%(?!\w)|(?<![\w$])\$({_NAME})\$(?!\w)|(?<![\w:]):({_NAME}):(?!\w)|%\(({_NAME})\)[sdif]")
# One-word names of template variables.
_VARIABLES = frozenset(
    "address amount author brand caption category city company content count country currency customer date day description discount email excerpt firstname footer first_name "
    "headline id image intro item keyword label lang language lastname link location message meta month name number order page password phone price product quantity region sku slug state "
    "store street subject subtitle summary tag text time title token total type url user username value variable year zip".split()
)
_HTML = frozenset("a b i p br em div span html head body strong img ul ol li table tr td th h1 h2 h3 code pre script style form input button".split())
#: Words of texts that are about templates, code or typesetting.
_ABOUT = re.compile(
    r"\b(templat\w*|placeholder\w*|syntax|braces?|brackets?|curly|shell|expand(?:s|ed)|interpolat\w*|escap(?:e|es|ed|ing)|snippet|variables?|regex\w*|parser rule|documentation|tutorial|code block|style guide|"
    r"vorlage\w*|platzhalter\w*|klammern?|modèles?|accolades?|crochets?|gabarit\w*|plantillas?|llaves|corchetes|marcadores?|шаблон\w*|скобк\w*|переменн\w*)\b",
    re.I,
)
_QUOTED = re.compile(r"`[^`\n]*`|```.*?```", re.S)

# The words of the usual filler text.
_LOREM = frozenset(
    "ad adipiscing adipisicing aliqua aliquip amet anim aute cillum commodo consectetur consequat culpa cupidatat deserunt do dolor dolore duis ea eiusmod elit enim esse est et eu ex "
    "excepteur exercitation fugiat id in incididunt ipsum irure labore laboris laborum lorem magna minim mollit nisi non nostrud nulla occaecat officia pariatur proident qui quis "
    "reprehenderit sed sint sit sunt tempor ullamco ut velit veniam voluptate".split()
)
_LOREM_STRONG = _LOREM - frozenset("ad do ea est et eu ex id in non qui ut magna minim nulla sit sed amet anim elit".split())
_WORD = re.compile(r"[^\W\d_]+")

_SITE = r"(?:\s*[|/–—-]\s*[^\W\d_][\w' ]{1,30})?"
_FILLER = re.compile(
    rf"(?:tb[da]|to ?do(?:[:!]| ?[-–] ).*|todo|fixme\b.*|xxx+(?:[ :].*)?|insert (?:an? |the |your )?\w+(?: here)?|(?:your|enter your|add your|place your|put your|type your) (?:\w+ ){{1,3}}here"
    rf"|(?:\w+ ){{1,2}}goes here|(?:sample|dummy|filler|placeholder|example) (?:text|page|post|title|content|heading|paragraph)(?: for [\w ]+)?|replace (?:this|me)\b[^.]*|xxx replace me|click (?:here )?to (?:edit|add)\b[^.]*"
    rf"|(?:test[ ,]*){{2,}}\d*|(?:asdf\w*[ ,]*)+|qwerty?|foo ?bar|untitled(?:[ -](?:document|page|post|design|\d+))*(?: ?\(\d+\))?|new (?:page|post|document)(?: ?\(\d+\))?|document ?\d*|blah(?: blah)*|todo \w+!+|\[(?:insert|your|add|enter|placeholder) [\w ]{{1,30}}\]|(\w+)(?: \1){{2,}}|lorem|texto de (?:ejemplo|relleno|muestra)|(?:escriba|inserte|introduzca|ponga) (?:aquí )?(?:su|el|un|tu) \w+(?: aquí)?|(?:su|tu) (?:texto|título) aquí"
    rf"|(?:platzhalter|beispieltext|mustertext|blindtext|fülltext)(?: für [\w ]+)?|hier (?:steht|kommt|folgt)(?: \w+){{0,2}} (?:ein|der|ihr) (?:text|titel|inhalt)|(?:titel|text|überschrift)(?: \w+)? hier(?: einfügen| eingeben)?|(?:ihr|ihre) (?:text|titel|überschrift) hier"
    rf"|(?:titre|texte|contenu|description)(?: de (?:la |l['’])?\w+)? (?:ici|à (?:remplacer|compléter|venir))|(?:insérez|saisissez|ajoutez|écrivez) (?:votre|un|le|ici)\b[\w ]*|votre (?:titre|texte) ici|exemple de texte|texte d['’]exemple"
    rf"|здесь (?:будет|должен быть) (?:ваш )?(?:текст|заголовок)|(?:заголовок|название|текст) (?:страницы|статьи|раздела)|(?:введите|вставьте|добавьте) (?:ваш |сюда )?\w+|(?:пример|образец) текста|текст[- ]заполнитель)[.!]*{_SITE}",
    re.I,
)
_EMPTY = r"(?:undefined|null|NaN|None|nil|Infinity|\[object Object\]|\(null\)|&nbsp;|function \(\) ?\{ ?\[native code\] ?\}|Invalid [Dd]ate|%!s\(MISSING\)|#(?:N/A|REF!|VALUE!|NAME\?|DIV/0!))"
_ALL_EMPTY = re.compile(rf"(?:[\w ]{{1,20}}:\s*)?{_EMPTY}(?:[\s,;/|–-]+{_EMPTY})*[.!]?{_SITE}")
_SOME_EMPTY = re.compile(rf"(?<![\w'\"‘“`]){_EMPTY}(?![\w'\"’”`])")
_OBJECT = re.compile(r"\[object Object\]|\[native code\]")
_ABOUT_VALUES = re.compile(r"\b(return\w*|means?|values?|keys?|function\w*|types?|results?|operators?|equals?|compar\w+|variables?|was never|check\w*|when|programm\w*|science|history|what|why|how)\b", re.I)

#: Error messages in place of a page. Each piece of the value must be one of these, a code or a site.
_MESSAGES = re.compile(
    r"(?:"
    # the page isn't there
    r"(?:the )?(?:requested )?(?:page|file|address|url|resource|document|site)(?: you requested| you are looking for)? (?:was |is |could |can |does |has )?(?:not (?:be )?found|not exist|no longer exists?|no longer available|been (?:re)?moved|gone|unavailable|suspended)(?: on this server)?|not found|(?:this|that) page (?:no longer exists|does not exist|is gone|is unavailable|could not be found)"
    r"|we (?:looked everywhere but|can(?:'|no)t find|could ?n['o]t find)\b.*|(?:hmm|oops|uh-oh|sorry|whoops)[,!.]? .{0,60}|that link seems to be broken|nothing (?:lives|to see) here"
    # not allowed
    r"|(?:access|permission) (?:was |is )?denied|forbidden|unauthori[sz]ed|you (?:do not|don't) have (?:permission|access)\b.*|your (?:address|ip|request|access) has been blocked.*|verify (?:that )?you are (?:a )?human.*|checking your browser.*|too many requests|(?:please )?log ?in to continue|(?:your )?session (?:has )?expired.*"
    # the server failed
    r"|(?:internal )?server error|bad (?:gateway|request)|gateway time-?out|(?:service|site|page|server) (?:is )?(?:temporarily )?(?:unavailable|suspended|overloaded|down)|(?:the )?service is unavailable|temporarily (?:unavailable|down)(?: for maintenance)?|(?:down|closed|offline) for maintenance|something went wrong|(?:an )?unexpected (?:application )?(?:error|failure)(?: occurred)?|an error (?:has )?occurred"
    r"|could not connect to (?:the )?(?:database|server).*|error establishing a database connection|connection (?:timed out|refused|reset|closed)|request timed? ?-?out|time-?out|(?:ssl )?certificate (?:problem|error|expired)|the upstream server .*|our engineers have been told.*|please try again.*|query failed(?::.*)?|fatal(?: error)?: .*|traceback\b.*|(?:warning|notice): (?:missing argument|undefined (?:index|variable|offset))\b.*|uncaught \w+.*|stack trace.*|\w+(?:error|exception): .*|reference \d+"
    # German
    r"|seite (?:wurde )?nicht gefunden|(?:die )?(?:angeforderte )?(?:seite|adresse)\b.{0,30}\b(?:nicht (?:\(mehr\)|mehr|gefunden|erreichbar|verfügbar)|gibt es nicht)\b.*|zugriff (?:wurde )?verweigert|interner serverfehler|(?:diese )?seite ist (?:vorübergehend )?nicht (?:erreichbar|verfügbar)|(?:dienst|service) (?:ist )?(?:vorübergehend )?nicht verfügbar|bitte versuchen sie es später.*|es ist ein (?:interner )?fehler aufgetreten|ein fehler ist aufgetreten|zeitüberschreitung.*|sitzung abgelaufen.*"
    # French
    r"|page (?:introuvable|non trouvée)|(?:cette|la) (?:page|adresse)\b.{0,30}\b(?:n['’]existe (?:pas|plus)|introuvable|nulle part)\b.*|accès (?:refusé|interdit)|erreur interne(?: du serveur)?|service (?:momentanément |temporairement )?indisponible|veuillez réessayer.*|une erreur (?:interne )?(?:s['’]est produite|est survenue).*|session expirée.*|délai d['’]attente dépassé"
    # Spanish
    r"|página no (?:encontrada|disponible)|(?:la )?(?:página|dirección)(?: solicitada)? no (?:existe|se encuentra|se ha encontrado).*|acceso (?:denegado|prohibido)|error interno(?: del servidor)?|se ha producido un error(?: interno)?.*|servicio (?:temporalmente )?no disponible|int[eé]ntelo de nuevo.*|sesión caducada.*|ha ocurrido un error.*"
    # Russian
    r"|страница не (?:найдена|существует)|(?:запрошенн\w+ |такой )?(?:адрес\w*|страниц\w*)(?: \w+)? не (?:существует|найден\w*).*|доступ (?:запрещ[её]н|закрыт)|внутренняя ошибка(?: сервера)?|(?:сервис|сайт|страница) (?:временно )?недоступ\w+|попробуйте (?:позже|ещ[её] раз).*|повторите попытку.*|произошла (?:внутренняя )?ошибка.*|что-то пошло не так|время ожидания истекло|сессия истекла.*"
    r")[.!…]*",
    re.I,
)
_CODE = r"(?:(?:http )?(?:error |status |code |fehler |erreur |ошибка )?(?:e-?\d{1,4}|\d{2,4})|http \d{3}|error|fehler|erreur|ошибка)"
_CODED = re.compile(rf"{_CODE}\s*(?:[:|–—-]\s*)?", re.I)
_CODE_ONLY = re.compile(r"(?:http(?: error)?|error|status|code|fehler|erreur|ошибка) (?:[45]\d\d|1020)[.!]?", re.I)
_OPENING = re.compile(r"warning|notice|fatal(?: error)?", re.I)
_PIECES = re.compile(r"(?:\.{1,3}|…|[:!?]| [|–—-])\s+")
_SITE_NAME = re.compile(r"[A-ZА-ЯЁ][\w'’&-]*(?: [A-ZА-ЯЁ][\w'’&-]*){0,2}[.!]?")

_SCRIPTS = r"(?:java ?script|js|scripts?|scripting|skripte?n?|скрипт\w*)"
_NOTICE = re.compile(
    rf"(?:(?:please|kindly|sorry|you (?:need|have|must)|you'll need|to (?:continue|proceed|view|see|use|run)|in order to|for full|this (?:site|page|app|application|website) (?:requires|needs|works))\b.{{0,70}}\b(?:enable|activate|allow|switch on|turn on|runs?|requires?|needs?|support(?:s|ing)?|unblock|use)\b.{{0,40}}\b{_SCRIPTS}\b.*"
    rf"|(?:please |kindly )?(?:enable|activate|allow|switch on|turn on) {_SCRIPTS}\b.*|this \w+ (?:requires|needs) {_SCRIPTS}\b.*|{_SCRIPTS} (?:is|are|has been|seems) (?:\w+ )?(?:disabled|blocked|required|needed|switched off|turned off)\b(?!,).*|your browser (?:has|does|is)\b.{{0,40}}\b{_SCRIPTS}\b.*|noscript\b.*|loading (?:application|app|page)?\W*if nothing happens.*"
    rf"|bitte\b.{{0,40}}\b{_SCRIPTS}\b.{{0,30}}\b(?:ein(?:schalten)?|aktivier\w+|erlauben|zulassen)\b.*|(?:diese|dieser|die) \w+ (?:benötigt|braucht|erfordert) {_SCRIPTS}\b.*|{_SCRIPTS} (?:ist|sind) (?:\w+ )?(?:deaktiviert|blockiert|nötig|erforderlich).*"
    rf"|(?:veuillez|merci d['’])\s*(?:activer|autoriser)\b.{{0,30}}\b{_SCRIPTS}\b.*|les {_SCRIPTS} sont (?:bloqués|désactivés|requis).*|cette (?:application|page) (?:nécessite|requiert|a besoin)\b.{{0,20}}{_SCRIPTS}\b.*"
    rf"|(?:por favor,? )?(?:active|habilite|permita)\b.{{0,20}}{_SCRIPTS}\b.*|(?:esta|este) \w+ (?:necesita|requiere) {_SCRIPTS}\b.*|(?:los )?{_SCRIPTS} est[áa]n? (?:bloquead|desactivad|deshabilitad)\w+.*"
    rf"|(?:пожалуйста,? )?(?:включите|разрешите)\b.{{0,20}}(?:java ?script|скрипт\w*).*|(?:это|этот|эта|для) \w+.{{0,40}}(?:требует\w*|нуж\w+|необходим\w*)\b.{{0,20}}(?:java ?script|скрипт\w*).*|(?:скрипты|javascript) (?:заблокирован\w*|отключ[её]н\w*).*)",
    re.I,
)
_BROWSER = re.compile(rf"\b(?:{_SCRIPTS}|browsers?|reload\w*|settings?|cookies?|navigateurs?|navegador\w*|einstellungen|браузер\w*)\b", re.I)

#: Messages of a run that could not obtain or read a page, and remarks on one that could.
_RUN_FAILED = re.compile(
    r"\b(fail(?:ed|ure|s)?|time(?:d)? ?-?out|blocked|empty (?:reply|response|body)|refused|reset by|unreachable|unreadable|could not|cannot|can't|unable|not (?:obtain|read|reach|fetch|parse|found)\w*|expecting a value|expecting|unexpected|invalid|truncated|cut short|torn|aborted|no (?:page text|reply|response|body|content)"
    r"|received error page|body was the notice|denied|forbidden|dns|tls|ssl|certificate|exception|traceback|too (?:large|many)|out of memory|unsupported|crash\w*|killed)\b",
    re.I,
)
_RUN_WORKED = re.compile(r"\b(complete(?:d)?|page read|ok|fine|none|n/a|no errors?|0 errors?|note|warning|kept|skipped|succe\w+|redirected once)\b", re.I)
_WRAPPED = re.compile(r"(?:blocked|no page text, only|body was the notice|received error page)\s*[:(]\s*", re.I)

#: Characters one of which every placeholder has (two colons, too).
_MARKS = ("{", "[", "<", "~", "%", "$", "«", "@", "_", "*", "#", "&lt;")
#: Up to these lengths a text is judged as a whole; longer ones sentence by sentence.
WHOLE_MESSAGE, WHOLE_NOTICE, WHOLE_VALUE = 600, 160, 90
_SENTENCES = re.compile(r"(?<=[.!?…])\s+|\n+")
_TRACE = re.compile(r"(?:traceback|stack trace|uncaught \w+|fatal(?: error)?:|query failed|\w+(?:error|exception):)", re.I)
_NO_VALUE = re.compile(r"\bNone (?:of|the|was|were|is)\b|\bInfinity\b")
#: Words in prose that are empty values elsewhere, and remarks on runs.
_PROSE_VALUE = re.compile(r"\bNone (?=[a-z])|\bnull and void\b|\bnil\b")
_RUN_REMARK = re.compile(r"\b(?:None|null|nil|Infinity)\b")


def placeholders(text: str) -> list[str]:
    """The unfilled placeholders of a text, those in code marks left out."""
    if not any(m in text for m in _MARKS) and text.count(":") < 2:
        return []
    bare = _QUOTED.sub(" ", text)
    hits = [m.group() for m in _STRONG.finditer(bare)]
    for m in _WEAK.finditer(_STRONG.sub(" ", bare)):
        name = next(g for g in m.groups() if g)
        if m.group(3) and name.lower() in _HTML:
            continue
        if len(name) > 1 and ("_" in name or "." in name or name.lower() in _VARIABLES or name.isupper() and len(name) > 2 and m.group()[0] in "%$<&~{["):
            hits.append(m.group())
    return hits


def _is_filler(text: str) -> bool:
    if _FILLER.fullmatch(text):
        return True
    sentences = _SENTENCES.split(text)
    if len(sentences) > 1 and any(_FILLER.fullmatch(x.strip()) for x in sentences) and not _ABOUT.search(text):
        return True
    low = text.lower()
    if _LOREM_STRONG.isdisjoint(low.replace(".", " ").replace(",", " ").split()):
        return False
    words = _WORD.findall(low)
    run = longest = strong = 0
    for w in words:
        run = run + 1 if w in _LOREM else 0
        longest = max(longest, run)
        strong += w in _LOREM_STRONG
    if len(words) >= 3 and strong >= 1 and all(w in _LOREM for w in words):
        return True
    if len(words) >= 2 and strong >= 2 and sum(w in _LOREM for w in words) >= 0.75 * len(words):
        return True
    return longest >= 6 and strong >= 4


def _is_error_page(text: str) -> bool:
    """Every piece of the value is an error message, a code or, behind one, a site's name."""
    whole = len(text) <= WHOLE_MESSAGE or _TRACE.match(text) is not None
    if whole and _MESSAGES.fullmatch(text) or _CODE_ONLY.fullmatch(text):
        return True
    rest = _CODED.sub("", text, count=1) if _CODED.match(text) else text
    if whole and _MESSAGES.fullmatch(rest):
        return True
    found = False
    for piece in _PIECES.split(rest):
        piece = piece.strip()
        coded = _CODED.match(piece)
        if not piece or coded and coded.end() == len(piece) or found and _OPENING.fullmatch(piece):
            continue
        if _MESSAGES.fullmatch(piece) or coded and _MESSAGES.fullmatch(piece[coded.end() :]):
            found = True
        elif re.match(r"(?:line \d+|'|\w*error|relation |allowed |missing )", piece, re.I) and found:
            continue
        elif not (found and _SITE_NAME.fullmatch(piece)):
            return False
    return found


def _has_empty_value(text: str, run_message: bool) -> bool:
    """An empty value inside a text, but for texts about values; in long texts the sentence around it tells."""
    if not _SOME_EMPTY.search(text) or _ABOUT.search(text):
        return False
    for part in [text] if len(text) <= WHOLE_VALUE else _SENTENCES.split(text):
        bare = _RUN_REMARK.sub(" ", part) if run_message else part if len(text) <= WHOLE_VALUE else _PROSE_VALUE.sub(" ", part)
        if _SOME_EMPTY.search(bare) and not _NO_VALUE.search(part) and not _ABOUT_VALUES.search(part):
            return True
    return False


def _is_notice(text: str) -> bool:
    """A script notice; in a long text most of it must be about scripts and browsers."""
    if not _NOTICE.fullmatch(text):
        return False
    if len(text) <= WHOLE_NOTICE:
        return True
    return sum(len(x) for x in _SENTENCES.split(text) if _BROWSER.search(x)) >= 0.5 * len(text) and not _ABOUT.search(text)


def residue(text: str | None, run_message: bool = False) -> str | None:
    """placeholder, empty_value, filler, error_page, script_notice or, for run messages, failure; else None.

    Null, empty and blank texts are None. ``run_message`` is for error fields of runs: there any
    other message that a page could not be obtained or read is a failure.
    """
    if text is None or not (text := text.strip()):
        return None
    hits = placeholders(text)
    if hits:
        share = sum(map(len, hits)) / len(text)
        if share >= 0.5 or not _ABOUT.search(re.sub(r"|".join(map(re.escape, hits)), " ", text)):
            return "placeholder"
    if _ALL_EMPTY.fullmatch(text) and not (run_message and text.lower() in ("none", "null", "nil")):
        return "empty_value"
    if "[" in text and _OBJECT.search(text) and not _ABOUT_VALUES.search(text) and not _ABOUT.search(text):
        return "empty_value"
    if _has_empty_value(text, run_message):
        return "empty_value"
    if _is_filler(text):
        return "filler"
    if _is_error_page(text):
        return "error_page"
    if _is_notice(text):
        return "script_notice"
    if run_message:
        inner = _WRAPPED.match(text)
        if inner or _RUN_FAILED.search(text) and not _RUN_WORKED.search(text):
            return "failure"
    return None


def _classify(run_message: bool):
    def classify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, str | None] = {}
        for batch in batches:
            if len(known) > 50_000:
                known.clear()
            kinds = [known[t] if t in known else known.setdefault(t, residue(t, run_message)) for t in batch.column(1).to_pylist()]
            found = pa.array([k is not None for k in kinds])
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(found), pa.array([k for k in kinds if k], pa.string())], names=["record_key", "kind"])

    return classify


def residue_rows(rows: DataFrame, key: str, text: str, run_message: bool = False) -> DataFrame:
    """(record_key, kind) of the rows whose text is residue instead of content.

    Redelivered rows count once (the last by ``received_at`` where the table has it). Null and empty
    texts and null keys are no cases; every other text is read whole, whatever its length.
    """
    columns = [F.col(key).cast("bigint").alias("k"), F.col(text).cast("string").alias("t"), *([F.col("received_at").alias("r")] if "received_at" in rows.columns else [])]
    slim = rows.select(*columns).filter("k is not null and t is not null")
    slim = latest(slim, ["k"], ["r"] if "r" in slim.columns else None)
    return slim.select("k", "t").mapInArrow(_classify(run_message), "record_key bigint, kind string")


def page_residue(pages: DataFrame, elements: DataFrame, costs: DataFrame) -> DataFrame:
    """(table_name, record_key, kind) over page titles, element texts and run errors."""
    parts = [("som_pages", residue_rows(pages, "page_id", "title")), ("som_elements", residue_rows(elements, "element_key", "text")), ("token_costs", residue_rows(costs, "cost_id", "error", run_message=True))]
    frames = [df.select(F.lit(name).alias("table_name"), "record_key", "kind") for name, df in parts]
    return frames[0].unionByName(frames[1]).unionByName(frames[2])
