"""Word lists for the queries: frequent tokens of the invented prose, written down as constants."""

TECH = ("with", "tion", "die", "les", "para")
UNRELATED = ("thean", "ereing")
STACK_A = ("the", "and", "of")
STACK_B = ("der", "die", "und")
TOOLS = ("ing", "ati", "ich", "ent", "ment")
CORE = ("that", "nicht", "dans")
BLOCKED = ("supplier#000000003", "supplier#000000007")
TITLE_OUT = ("the", "que", "ein")
ROLE_OUT = ("is", "zu", "por")
ROLE_NOUNS = ("that", "with", "les")
PHRASES = {"fr": ("les", "des", "dans", "que la"), "de": ("der", "und", "nicht"), "en": ("the ", "that", "with")}
MODES = (("remote", ("that the", "les des")), ("hybrid", ("with", "und", "dans")), ("remote", ("of the",)))
PLACES = (("of the", "US"), ("the", "GB"), ("la", "ES"), ("les", "FR"), ("der", "DE"), ("und", "AT"))
GROUP_A = ("that", "nicht")
GROUP_B = ("with", "les", "und")
GROUP_C = ("the", "dans", "die")
TRUSTED = ("src1", "src2")
CLAUSES = ("that of the", "zu der", "que de la", "les la")
SIGNALS = (("tion", 24, "first signal"), ("and the", 26, "second signal"), ("der", 18, "third signal"), ("que", 18, "fourth signal"))
KEYWORDS = ("the", "tion", "und", "ich", "les", "ment", "para", "ado", "with")
GROUPS = (("that", "dass"), ("ing", "ung"), ("ent", "ant"))
SPONSOR = ("by the", "in der", "por el")
DOMAIN = ("er", "est", "los")
EXCLUDED_COUNTRIES = ("CHINA", "RUSSIA")
HOME_COUNTRY = "FRANCE"
TIER2 = ("GERMANY", "ROMANIA")
TIER3 = ("UNITED KINGDOM",)
OVERSEAS = ("UNITED STATES", "CANADA")
EUROPE = ("FRANCE", "GERMANY", "ROMANIA", "RUSSIA", "UNITED KINGDOM")
