"""Vocabularies and limits of the record-linkage operators: fixed values that results depend on."""

# Legal forms dropped from names when keys are derived.
LEGAL = (
    "inc incorporated llc ltd limited corp corporation co company plc pvt private lp llp pllc pc pa gmbh ag sa srl bv nv pty lllp psc ltda opc pvtltd "
    "sarl sas sasu eurl sci snc selarl scp scop cie enterprises enterprise partners"
).split()
# Legal forms that may be glued to the word before, longest first.
LEGAL_GLUED = "incorporated corporation limited company private pvtltd sarl sasu eurl pllc inc llc ltd corp plc llp pvt".split()
# The smaller set that similarity features drop.
LEGAL_FEATURES = "inc incorporated llc ltd limited corp corporation co company plc pvt private lp llp pllc pc pa and the of sarl sas sasu eurl sci snc enterprises partners sri shri shree".split()
# Honorifics and stop words of names.
HONORIFIC = "sri shri shree smt mr mrs ms messrs".split()
STOP = "the and of a an et de la le les du des d l en au aux www com net org http https id".split()
# Spellings that stand for another word.
NAME_CANON = {
    "intl": "international", "svc": "services", "svcs": "services", "mgmt": "management", "assoc": "associates", "assocs": "associates", "assn": "association",
    "ctr": "center", "centre": "center", "hosp": "hospital", "med": "medical", "univ": "university", "dept": "department", "natl": "national", "bros": "brothers",
    "mfg": "manufacturing", "tech": "technology", "techs": "technologies", "grp": "group",
}
# Digits read as letters inside words.
LEET_FROM, LEET_TO = "0134578", "oleastb"
# Address words without meaning, ordinals, and words that are no street name.
ADDR_JUNK = "null none nan na nil ind india usa us france".split()
ORDINAL_WORDS = {"first": "1", "second": "2", "third": "3", "fourth": "4", "fifth": "5", "sixth": "6", "seventh": "7", "eighth": "8", "ninth": "9", "tenth": "10"}
DIRECTIONS = "n s e w ne nw se sw north south east west northeast northwest southeast southwest".split()
UNIT_WORDS = (
    "unit suite ste apt apartment fl floor bldg building room rm no number po box # near nr opp opposite behind beside next to shop plot flat house h sector "
    "block ward gali lane marg bis ter quater de la le les du des d l of the"
).split()
STREET_TYPES = (
    "street st road rd drive dr avenue ave av boulevard blvd bd court ct place pl highway hwy parkway pkwy circle cir square sq terrace ter trail trl way ln "
    "rue chemin allee impasse route quai cours voie passage sentier rte che imp all saint"
).split()
STREET_CANON = {"mount": "mt", "fort": "ft"}

#: Blockers in order of their bit, each with the most vendor records that a block may hold.
BLOCKERS = {
    "compact": 200, "sorted": 200, "prefix": 100, "suffix": 100, "phonetic": 100, "rare1": 100, "rare2": 100,
    "addr": 50, "addrname": 100, "postname": 100, "postrare": 100, "apair": 30, "nameaddr": 30, "numname": 30,
}
BITS = {name: i for i, name in enumerate(BLOCKERS)}
#: Key column of each blocker; those in LIST_KEYS hold several keys for a record.
KEY_COLUMNS = {
    "compact": "k_compact", "sorted": "k_sorted", "prefix": "k_pre", "suffix": "k_suf", "phonetic": "k_phon", "rare1": "k_rare1", "rare2": "k_rare2",
    "addr": "k_addr", "addrname": "k_addrname", "postname": "k_postname", "postrare": "k_postrare", "apair": "k_apair", "nameaddr": "k_nameaddr", "numname": "k_numname",
}
LIST_KEYS = ("k_compact", "k_rare2", "k_apair", "k_nameaddr", "k_numname")
AFFIX_CHARS = 8
RARE1_MAX_DF, RARE2_MAX_DF = 2000, 200_000
