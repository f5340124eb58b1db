"""Fixed values of the annotation formats: lookup tables that results depend on."""

PUNCTUATION = {":": "yyCLN", ",": "yyCM", "-": "yyDASH", ".": "yyDOT", "...": "yyELPS", "!": "yyEXCL", "(": "yyLRB", "?": "yyQM", ")": "yyRRB", ";": "yySCLN", '"': "yyQUOT"}

LETTERS = "אבגדהוזחטיכלמנסעפצקרשת0123456789\"%.,"
LATIN = "ABGDHWZXJIKLMNSEPCQRFT0123456789UO.,"
FINAL_LETTERS = "ךםןץף"
FINAL_LATIN = "KMNCP"
BEFORE_FINAL = "כמנפצ"
AS_FINAL = "ךםןףץ"

OPEN_CLASSES = {
    "HEBTB": ("ADVERB", "BN", "BNT", "CD", "CDT", "JJ", "JJT", "NN", "NNP", "NNT", "RB", "VB"),
    "UD": ("ADJ", "AUX", "ADV", "PUNCT", "NUM", "INTJ", "NOUN", "PROPN", "VERB"),
}

UNIVERSAL_PREFIX_TAG = {"ADVERB": "ADP", "CONJ": "CCONJ", "DEF": "DET", "PREPOSITION": "ADP", "REL": "SCONJ", "TEMP": "SCONJ"}

UNIVERSAL_TAG = {
    "AT": "PART-Case=Acc", "BN": "VERB-VerbForm=Part", "BNT": "VERB-Definite=Cons|VerbForm=Part", "CC": "CCONJ", "CC-SUB": "SCONJ",
    "CC-COORD": "SCONJ", "CC-REL": "SCONJ", "CD": "NUM", "CDT": "NUM-Definite=Cons", "COP": "AUX-VerbType=Cop", "DT": "DET-Definite=Cons",
    "DTT": "DET-Definite=Cons", "EX": "VERB-HebExistential=True", "IN": "ADP", "INTJ": "INTJ", "JJ": "ADJ", "JJT": "ADJ-Definite=Cons",
    "MD": "AUX-VerbType=Mod", "NEG": "ADV", "NN": "NOUN", "NNP": "PROPN", "NNT": "NOUN-Definite=Cons", "NNPT": "PROPN-Abbvr=Yes",
    "P": "ADV-Prefix=Yes", "POS": "PART-Case=Gen", "PRP": "PRON", "QW": "ADV-PronType=Int", "RB": "ADV-Polarity=Neg", "TTL": "NOUN-Title=Yes", "VB": "VERB",
}

#: Feature of the source scheme -> universal feature; None: the feature goes.
UNIVERSAL_FEATURE = {
    "gen=F": "Gender=Fem", "gen=M": "Gender=Masc",
    "num=S": "Number=Sing", "num=P": "Number=Plur", "num=D": "Number=Dual", "num=Underspecified": "Number=Underspecified",
    "per=1": "Person=1", "per=2": "Person=2", "per=3": "Person=3", "per=A": "Person=1,2,3",
    "def=D": "Definite=Def", "def=-": "Definite=Ind", "polar=pos": "Polarity=Pos", "polar=neg": "Polarity=Neg",
    "tense=PAST": "Tense=Past", "tense=PRESENT": "Tense=Pres", "tense=FUTURE": "Tense=Fut", "tense=IMPERATIVE": "Mood=Imp", "tense=BEINONI": "Tense=Part",
    "type=DEM": "PronType=Dem", "type=IMP": "PronType=Ind", "type=PERS": "PronType=Prs", "type=REF": "PronType=Prs|Reflex=Yes", "type=TOINFINITIVE": "VerbForm=Inf",
    "binyan=HITPAEL": None, "binyan=PAAL": "HebBinyan=PAAL", "binyan=NIFAL": "HebBinyan=NIFAL", "binyan=PIEL": "HebBinyan=PIEL",
    "binyan=PUAL": "HebBinyan=PUAL", "binyan=HIFIL": "HebBinyan=HIFIL", "binyan=HUFAL": "HebBinyan=HUFAL",
}

#: Code in a lexicon entry -> its features.
MSR_FEATURE = {
    "1": "per=1", "2": "per=2", "3": "per=3", "A": "per=A", "BEINONI": "tense=BEINONI", "D": "num=D", "DP": "num=D|num=P", "F": "gen=F",
    "FUTURE": "tense=FUTURE", "IMPERATIVE": "tense=IMPERATIVE", "M": "gen=M", "MF": "gen=F|gen=M", "SP": "num=S|num=P", "NEGATIVE": "polar=neg",
    "P": "num=P", "PAST": "tense=PAST", "POSITIVE": "polar=pos", "S": "num=S", "PERS": "type=PERS", "DEM": "type=DEM", "REF": "type=REF",
    "IMP": "type=IMP", "INT": "type=INT", "HIFIL": "binyan=HIFIL", "PAAL": "binyan=PAAL", "NIFAL": "binyan=NIFAL", "HITPAEL": "binyan=HITPAEL",
    "PIEL": "binyan=PIEL", "PUAL": "binyan=PUAL", "HUFAL": "binyan=HUFAL", "TOINFINITIVE": "type=TOINFINITIVE", "BAREINFINITIVE": "type=BAREINFINITIVE",
    "COORD": "type=COORD", "SUB": "type=SUB", "REL": "type=REL", "SUBCONJ": "type=SUBCONJ",
}

#: Codes of a pronominal suffix -> pronoun; others give OTHER_PRONOUN.
PRONOUN = {"MF-P-1": "אנחנו", "MF-S-1": "אני", "F-S-2": "את", "M-S-2": "אתה", "M-P-2": "אתם", "F-P-2": "אתן", "M-S-3": "הוא", "F-S-3": "היא", "M-P-3": "הם", "F-P-3": "הן"}
OTHER_PRONOUN = "הם"
#: Tags whose suffixes are features of the host; the tags of the word between host and pronoun, and of the pronoun.
SUFFIX_IN_HOST = ("NN", "DT", "EX", "PRP", "PRP-REF", "PRP-PERS", "QW")
BRIDGE_TAG, PRONOUN_TAG = "POS", "S_PRN"
BRIDGE = {"CD": "של", "NN": "של", "VB": "את", "BN": "את", "IN": "", "INTJ": "", "RB": ""}

#: The published templates for dependency arcs (Zhang and Nivre, 2011), as template strings of operators/features.py.
ARC_TEMPLATES = (
    "S0|w,S0|w", "S0|p,S0|w", "S0|w|p,S0|w",
    "N0|w,N0|w", "N0|p,N0|w", "N0|w|p,N0|w",
    "N1|w,N1|w", "N1|p,N1|w", "N1|w|p,N1|w",
    "N2|w,N2|w", "N2|p,N2|w", "N2|w|p,N2|w",
    "S0h|w,S0h|w", "S0h|p,S0h|w", "S0|l,S0h|w",
    "S0h2|w,S0h2|w", "S0h2|p,S0h2|w", "S0h|l,S0h2|w",
    "S0l|w,S0l|w", "S0l|p,S0l|w", "S0l|l,S0l|w",
    "S0r|w,S0r|w", "S0r|p,S0r|w", "S0r|l,S0r|w",
    "N0l|w,N0l|w", "N0l|p,N0l|w", "N0l|l,N0l|w",
    "S0l2|w,S0l2|w", "S0l2|p,S0l2|w", "S0l2|l,S0l2|w",
    "S0r2|w,S0r2|w", "S0r2|p,S0r2|w", "S0r2|l,S0r2|w",
    "N0l2|w,N0l2|w", "N0l2|p,N0l2|w", "N0l2|l,N0l2|w",
    "S0|w|p+N0|w|p,S0|w", "S0|w|p+N0|w,S0|w", "S0|w+N0|w|p,S0|w", "S0|w|p+N0|p,S0|w", "S0|p+N0|w|p,S0|w", "S0|w+N0|w,S0|w", "S0|p+N0|p,S0|w",
    "N0|p+N1|p,S0|w;N0|w", "N0|p+N1|p+N2|p,S0|w;N0|w", "S0|p+N0|p+N1|p,S0|w;N0|w", "S0|p+N0|p+N0l|p,S0|w;N0|w", "N0|p+N0l|p+N0l2|p,S0|w;N0|w",
    "S0h|p+S0|p+N0|p,S0|w", "S0h2|p+S0h|p+S0|p,S0|w", "S0|p+S0l|p+N0|p,S0|w", "S0|p+S0l|p+S0l2|p,S0|w", "S0|p+S0r|p+N0|p,S0|w", "S0|p+S0r|p+S0r2|p,S0|w",
    "S0|w|d,S0|w;N0|w", "S0|p|d,S0|w;N0|w", "N0|w|d,S0|w;N0|w", "N0|p|d,S0|w;N0|w", "S0|w+N0|w|d,S0|w;N0|w", "S0|p+N0|p|d,S0|w;N0|w",
    "S0|w|vr,S0|w", "S0|p|vr,S0|w", "S0|w|vl,S0|w", "S0|p|vl,S0|w", "N0|w|vl,N0|w", "N0|p|vl,N0|w",
    "S0|w|sr,S0|w", "S0|p|sr,S0|w", "S0|w|sl,S0|w", "S0|p|sl,S0|w", "N0|w|sl,N0|w", "N0|p|sl,N0|w",
)

#: The templates of path choice, as template strings of operators/choice.py.
CHOICE_TEMPLATES = (
    "M0|m,M0|m", "M0|p,M0|m", "M0|mp,M0|m", "M0|f,M0|m", "M0|m|f,M0|m", "M0|p|f,M0|m", "M0|mp|f,M0|m",
    "M0|m+M1|m,M0|m;M1|m", "M0|m|f+M1|m,M0|m;M1|m", "M0|mp+M1|m,M0|m;M1|m", "M0|mp|f+M1|m,M0|m;M1|m",
    "M0|m+M1|mp,M0|m;M1|m", "M0|m|f+M1|mp,M0|m;M1|m", "M0|mp+M1|mp,M0|m;M1|m", "M0|mp|f+M1|mp,M0|m;M1|m",
    "M0|p+M1|p,M0|m;M1|m", "M0|p|f+M1|p|f,M0|m;M1|m", "M0|p|f+M1|p,M0|m;M1|m", "M0|f+M1|p,M0|m;M1|m",
    "M0|m+M1|m+M2|m,M0|m;M1|m;M2|m", "M0|p+M1|p+M2|p,M0|m;M1|m;M2|m", "M0|mp+M1|mp+M2|mp,M0|m;M1|m;M2|m",
    "M0|mp|f+M1|mp+M2|mp,M0|m;M1|m;M2|m", "M0|mp|f+M1|mp|f+M2|mp|f,M0|m;M1|m;M2|m", "M0|f+M1|p+M2|p,M0|m;M1|m;M2|m",
    "L1|n,L1|n", "L1|n|a,L1|n", "L1|n|t,L1|n", "L1|t,L1|n",
    "L0|n,L0|n", "L0|n|a,L0|n", "L0|n|t,L0|n", "L0|t,L0|n", "L0|g,L0|t", "L0|e,L0|t", "L0|x,L0|t",
    "L-1|n,L-1|n", "L-1|n|a,L-1|n", "L-1|n|t,L-1|n", "L-1|t,L-1|n",
    "L1|i+L0|n,L0|n", "L1|i+L0|n|a,L0|n", "L1|i+L0|n|t,L0|n", "L1|i|a+L0|n,L0|n", "L1|i|a+L0|n|a,L0|n", "L1|i|a+L0|n|t,L0|n", "L1|i|t+L0|n,L0|n", "L1|i|t+L0|n|a,L0|n", "L1|i|t+L0|n|t,L0|n",
    "L-1|i+L0|n,L0|n", "L-1|i+L0|n|a,L0|n", "L-1|i+L0|n|t,L0|n", "L-1|i|a+L0|n,L0|n", "L-1|i|a+L0|n|a,L0|n", "L-1|i|a+L0|n|t,L0|n", "L-1|i|t+L0|n,L0|n", "L-1|i|t+L0|n|a,L0|n", "L-1|i|t+L0|n|t,L0|n",
    "L-1|i,n/a", "L-1|i|t,n/a", "L-1|i|a,n/a",
)
