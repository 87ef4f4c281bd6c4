"""Character classes that mean the same to Java's and RE2's regular expressions as to Python's str methods."""

#: What Python's str.split, strip and isspace take for blank.
BLANK = r"\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
WS = f"[{BLANK}]"
#: Where str.splitlines cuts.
NL = r"\r\n|[\x0a-\x0d\x1c-\x1e\x{85}\x{2028}\x{2029}]"
#: Letters and numbers; with the underscore, word characters.
ALNUM = r"[\p{L}\p{N}]"
WORD = r"[\p{L}\p{N}_]"
DIGITS = r"\p{Nd}+"
#: After one of these a line break ends a sentence and stays.
STOPS = ".!?\"'’”)]"
#: The characters of BLANK, and those at which a line ends, one by one and as members of a class.
BLANKS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
CUTS = "\n\x0b\x0c\r\x1c\x1d\x1e\x85\u2028\u2029"
BREAKS = r"\x0a-\x0d\x1c-\x1e\x{85}\x{2028}\x{2029}"
