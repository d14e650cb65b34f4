r"""Values that results depend on, as they are: configurations of the pattern scanners and of copyright statements.

Each line is NAME=pattern in POSIX style. ``__NAME__`` stands for the value that NAME has so far, for nothing if it
has none; a later line of a name replaces the earlier one. Letters in bytes (``\xC2\xA9``) are UTF-8.
"""

# Web addresses, e-mail addresses, authors.
CONTACTS = r"""
url=(?:(?:ht|f)tps?://[^\s<>\"'`\[\]{}\\|\^]+?)(?=[\s<>\"'`\[\]{}\\]|$)
EMAILPART=[\w\-\.\+]{1,100}
TLD=[a-zA-Z]{2,24}(?<!test)(?<!invalid)
email=[\<\(]?(__EMAILPART__@__EMAILPART__\.__TLD__)(?<!example\.(com|net|org))[\>\)]?
website=(?:http|https|ftp)\://[a-zA-Z0-9\-\.]+\.__TLD__(?<!example\.(com|net|org))(:[a-zA-Z0-9]*)?/?([a-zA-Z0-9\-\._\?\,'/\\+&amp;%\$#\=~])*[^\.\,\)\(\s]
SPACES=[\t ]+
SPACESALL=[[:space:]]*
ALPHA=[:alpha:]\xc0-\xd6\xd9-\xf6\xf8-\xff
NAME_OR_COMPANY=(?:[__ALPHA__]+|__email__|__website__)
NAMESLIST=__NAME_OR_COMPANY__(?:[\-, &]+__NAME_OR_COMPANY__)*
author=(?:(?:author|contributor|maintainer)s?)
author=__author__|(?:(?:written|contribut(?:ed|ions?)|maintained|modifi(?:ed|cations?)|put__SPACES__together)__SPACES__by)
author=(?:__author__)[:]?
author=__author____SPACESALL____NAMESLIST__\.?
author=__author__|(?<=<author>)(.*?)(?=<\/author>)
"""

# Export control.
EXPORT_CONTROL = r"""
SPACES=[\t ]+
ecc=__ecc__\beccn\b|\btsu\b|\becc\b|\bccl\b|\bwco\b|\bear99\b
ecc=__ecc__|(export__SPACES__control)
ecc=__ecc__|(foreign__SPACES__trade(__SPACES__regulations)?)
ecc=__ecc__|(commerce__SPACES__control)
ecc=__ecc__|(country__SPACES__of__SPACES__origin)
ecc=__ecc__|(export__SPACES__administration)
ecc=__ecc__|(information__SPACES__security)
ecc=__ecc__|(dual-use)
ecc=__ecc__|(nuclear|surveillance|military|defense|marine|avionics|laser)
ecc=__ecc__|(propulsion__SPACES__systems)
ecc=__ecc__|(space__SPACES__vehicle(s)?)
ecc=__ecc__|(dual__SPACES__use)
ecc=(__ecc__)[^)\n]{0,60}
"""

# Patents.
PATENTS = r"""
SPACES=[\t ]+
ipra=__ipra__\b(patent(ability|ed|ee|ing))
ipra=__ipra__|(fair__SPACES__use)
ipra=(__ipra__)[[:space:][:punct:]]+
ipra=(__ipra__)[[:alpha:]]*
ipra=(__ipra__)[[:punct:]]*
ipra=(__ipra__)[[:alpha:]]*
ipra=(__ipra__)[[:space:]]*
ipra=(__ipra__)[[:print:]]{0,60}
"""

# Keywords.
KEYWORDS = r"""
SPACESALL=[[:space:]]*
keyword=__keyword__(keyword__SPACESALL__workaround)
keyword=__keyword__|(licensed__SPACESALL__as)
keyword=__keyword__|(licensed__SPACESALL__by)
keyword=__keyword__|(licensed__SPACESALL__from)
keyword=__keyword__|(licensed__SPACESALL__under)
keyword=__keyword__|(modify__SPACESALL__it__SPACESALL__under)
keyword=__keyword__|(non - commercial)
keyword=__keyword__|(noncommercially)
keyword=__keyword__|(patented)
keyword=__keyword__|(patent)
keyword=__keyword__|(stolen__SPACESALL__from)
keyword=__keyword__|(copied__SPACESALL__from)
keyword=__keyword__|(derived__SPACESALL__from)
keyword=__keyword__|(taken__SPACESALL__from)
keyword=__keyword__|((private|personal)__SPACESALL__use__SPACESALL__only)
"""

# How copyright statements begin and go on, what is none, and what is cut off their end.
STATEMENTS = r"""
COPYSYM=(?:\(c\)|&copy;|(?<!\xC3)\xA9|\xC2\xA9|\xE2\x92\xB8|\xE2\x93\x92|\xE2\x92\x9E)
REG_COPYRIGHT=(?:spdx-filecopyrighttext|\bcopyright(?:ed|s)?\b)[[:space:]:]*|__COPYSYM__[ \t]+(?:\.?[[:upper:]][[:lower:]]{2,}|[[:upper:]]?[[:lower:]]{5,}|(?:19|20)[[:digit:]]{2}|\([cC]\))[^\0]*
REG_EXCEPTION=\bcopyrights?(?:[ \t/\\\*\+#"\.-]+)(?:licen[cs]es?|notices?|holders?|and|statements?|owners?)[ \t\.,][^\0]*
REG_EXCEPTION_COPY=(?:\b(?:copyright|copyrights|copyrighted)\b|__COPYSYM__)(?:[A-Z][a-zA-Z]+|(?:[\W_]*\(?(?:c|C)\)?[\W_]*)?(?:[\W_]+)(?:licen[cs]es?|notices?|files?|laws?|authors?|holders?|and|neither|including|grant|help|redistributions?|not|sources?|each|any|forums?|softwares?|individuals?|for|materials?|years?|patents?|statements?|owners?|texts?|disclaimer|design|designation|Act|permission|appearing|apply|appli|is|are|was|were|will|have|has|do|does|since|depuis|full|complete|entire|respective|work|protection|interfaces?|to|in|of|on|To[A-Z][a-zA-Z]{4,}|Block[s]?|Handler|Helper|Header|Footer|Template|Provider)\b)[^\0]*
REG_NON_BLANK=.*(?:[[:alpha:]][[:alpha:]]|[[:digit:]][[:digit:]]).*
REG_SIMPLE_COPYRIGHT=\bcopyright\b|__COPYSYM__
REG_SPDX_COPYRIGHT=spdx-filecopyrighttext[[:space:]]*[:=](.*)
REG_REMOVE_FILE_STATEMENT=^\s*copyright\s+file\s*=.*
REG_STRIP_LICENSE_TRAIL=(?i)(License:,|Licensed under|may be freely distributed under|permission to use|released under|Redistributions?).*$
REG_STRIP_TRADEMARK_TRAIL=\)\]\s*\[assembly: AssemblyTrademark\(.*$
REG_ALL_RIGHT_RESERVE_TRAIL=(?i)(all rights? reserve).*$
REG_EXCEPTION_VERB_FOLLOW=\bcopyrights?[[:space:]]*(?:appear\w*|apply|appli|is|are|was|were|will|have|has|do|does)\b[^\0]*
REG_EXCEPTION_ADJECTIVE_PREFIX=(?i)(?:full|the|a|any|no|this|all|your|their|complete|entire)[[:space:]]+copyright[^\0]*
REG_EXCEPTION_TEMPLATE=__COPYSYM__[[:space:]]*[\{<\$%][^\0]*
REG_EXCEPTION_PASSIVE=\bcopyrighted[[:space:]]+by[[:space:]]+(?:their|his|her|its|all|any|the|respective)\b[^\0]*
REG_STRIP_COPYSYM_NONYEAR=__COPYSYM__[ \t]*(?![[:space:]]*(?:(?:19|20)[[:digit:]]{2}|\(?[cC]\)?|\.?[[:upper:]][[:lower:]]{2,}))[^\0]*
REG_EXCEPTION_BINARY_NOISE=__COPYSYM__[ \t]*(?:[^\x00-\x7F]|[\x21-\x7E]{1,8}[^\x00-\x7F])[^\0]*
REG_EXCEPTION_META=__COPYSYM__[[:space:]]+(?:using|block[s]?|structure|comment[s]?|add|insert|include|handling|notice[s]?|representing|identifies?|Green|this\.|entry)[^\0]*
REG_EXCEPTION_CHARNAME_RUN=\bcopyright(?:[^\x00-\x7F][\x00-\xFF]*tEXt(?:Creation|Software|Disclaimer|Warning|Source|Comment|Title)|(?:ordfeminine|ordmasculine|guillemot|logicalnot|registered|degree|plusminus|paragraph|cedilla|questiondown|twosuper|threesuper|onesuper|onequarter|onehalf|threequarter))[^\0]*
"""

# Noise inside statements, characters trimmed from their ends (both, start, end), spellings of the first
# word with what stands for it, endings cut off (the first that fits), the longest statement.
NOISE = ["<p>", "<a href", "date-of-software", "date-of-document", " $ ", " ? ", "</a>", "( )", "()"]
TRIMMED, TRIMMED_AT_START, TRIMMED_AT_END = " \t,'\"-:;&@!", ".>)]\\/", "<([\\/"
FIRST_WORDS = [
    "SPDX-FileCopyrightText", "AssemblyCopyright", "AppCopyright", "JCOPYRIGHT",
    "COPYRIGHT Copyright", "Copyright Copyright", "Copyright copyright", "copyright copyright", "copyright Copyright", 'copyright"Copyright', 'copyright" Copyright',
]
FIRST_WORD = "Copyright"
ENDINGS = ["copyright", ",", "year", "parts", "0", "1", "author", "all", "some", "and"]
LONGEST_STATEMENT = 300

# Patterns of license tags.
TAG_LIST = r"(?i)spdx-licen[cs]e(?:id|[- ]identifier): ((?:(?: (?:and|or|with) )?\(?(?:[\w\d.+\-]{3,})\)?){1,5})"
TAG_NAMES = r"(?i)(?: and | or | with )?\(?([\w\d.+\-]{1,}[\w\d+])\)?"
TAG_DUAL = r"(?i) (and|or|with)? "
DUAL = "Dual-license"
