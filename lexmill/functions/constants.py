"""Fixed values that results depend on: word lists, patterns, weights.

They must stay as they are for results to agree; they are stated plainly, in
natural order.  Patterns are written for Java regular expressions.
"""

# Stop words of the corpus tokenizer.
STOP_CORPUS = (
    "the a an and or but in on at to for of with by from as is was are were been be have has had do does did will would could should may might must shall can need it its this that these those "
    "i you he she we they me him her us them my your his our their what which who whom when where why how all each every both few more most other some such no not only own same so than too very just also"
).split()
# The vocabulary tokenizer knows a few more.
STOP_VOCAB = STOP_CORPUS + "said then now here there yes".split()
# Stop words of the question keyword extractor.
STOP_QUESTION = (
    "the a an is are was were be been being have has had do does did will would could should may might must shall can need dare ought used to of in for on with at by from as into through during before after "
    "above below between under again further then once here there when where why how all each few more most other some such no nor not only own same so than too very just also now what who which this that these "
    "those i you he she it we they them his her its our their my your and but or if because while although though unless"
).split()

WORD_TOKEN = r"\b[a-zA-Z][a-zA-Z0-9'-]*[a-zA-Z0-9]\b|\b[a-zA-Z]\b"

# Corpus statistics and BM25.
AVERAGE_DOC_LENGTH = 5000
OOV_IDF = 10.0
K1, B = 1.2, 0.75
MIN_BM25_SCORE = 2.0
MAX_BM25_TERMS = 100
MIN_CORPUS_DOCS = 5
# BM25+ of retrieval.
PLUS_K1, PLUS_B, PLUS_DELTA = 1.5, 0.75, 1.0

# Case numbers.
CASE_NUMBER_PATTERNS = [
    r"(?iu)Case\s+No\.?\s*:?\s*\d+:\d+-\w+-\d+",
    r"(?iu)Index\s+No\.?\s*:?\s*\d+/\d{4}",
    r"(?iu)Docket\s+No\.?\s*:?\s*\d+-\d+",
    r"(?iu)Case\s+No\.?\s*:?\s*\d+",
]

# Lines.
MIN_LINE_LENGTH = 15
LEGAL_HEADER_WORDS = "COURT PLAINTIFF DEFENDANT APPEARANCES SUPREME MOTION AFFIDAVIT EXHIBIT DEPOSITION TESTIMONY COMPLAINT ANSWER SUMMONS NOTICE ORDER JUDGE ATTORNEY COUNSEL PARTY ACTION".split()
PAGE_NUMBER_LINE = r"^(?:[Pp][Aa][Gg][Ee]\s+\d+(?:\s+[Oo][Ff]\s+\d+)?|[-–]\s*\d+\s*[-–]|\d{1,4}|[Pp][Gg]?\.?\s*\d+|\d+/\d+)$"

# Headers and footers.
MIN_HEADER_OCCURRENCES = 3
MAX_HEADER_LENGTH = 120
HEADER_FOOTER_PATTERNS = [
    r"^\s*-?\s*\d+\s*-?\s*$", r"page\s+\d+\s*(of\s+\d+)?", r"\bpage\s*:?\s*\d+", r"^\s*v\.?\s*$", r"plaintiff.*defendant", r"index\s*(?:no\.?|number)", r"case\s*(?:no\.?|number)",
    r"docket\s*(?:no\.?|number)", r"supreme\s+court", r"court\s+of\s+(?:the\s+)?state", r"reporting\s+(?:service|company)", r"certified\s+court\s+reporter", r"confidential", r"privileged",
    r"not\s+for\s+(?:public\s+)?distribution", r"deposition\s+of", r"examination\s+before\s+trial", r"transcript\s+of", r"exhibit\s+\d+", r",?\s*(?:LLP|PLLC|P\.?C\.?|LLC|L\.L\.C\.)\s*$",
]

# Title pages: (pattern, points).  "(?m)" marks the line-anchored ones.
TITLE_PAGE_PATTERNS = [
    (r"(?i)SUPREME\s+COURT", 2), (r"(?i)CIVIL\s+COURT", 2), (r"(?i)DISTRICT\s+COURT", 2), (r"(?i)COURT\s+OF\s+(?:THE\s+)?STATE", 2), (r"(?i)COUNTY\s+OF\s+[A-Z]+", 1),
    (r"(?m)^\s*[-x]+\s*$", 1), (r"(?i)PLAINTIFF[,\s]", 2), (r"(?i)DEFENDANT[,\s]", 2), (r"(?i)\s+-\s*against\s*-\s+", 2), (r"(?im)^\s*v\.?\s*$", 1),
    (r"(?i)INDEX\s*(?:NO\.?|NUMBER)", 2), (r"(?i)CASE\s*(?:NO\.?|NUMBER)", 2), (r"(?i)DOCKET\s*(?:NO\.?|NUMBER)", 2), (r"(?i)DEPOSITION\s+OF\s+[A-Z]", 3), (r"(?i)EXAMINATION\s+BEFORE\s+TRIAL", 3), (r"(?i)ORAL\s+DEPOSITION", 2),
    (r"(?i)ATTORNEY[S]?\s+FOR", 2), (r"(?i)COUNSEL\s+FOR", 2), (r"(?i)LAW\s+OFFICE[S]?\s+OF", 1), (r"(?i),?\s*(?:ESQ\.?|ESQUIRE)", 1), (r"(?i)COURT\s+REPORTER", 2), (r"(?i)CERTIFIED\s+SHORTHAND", 2), (r"(?i)REPORTING\s+(?:SERVICE|COMPANY)", 1),
    (r"(?i)APPEARANCES?:", 2), (r"(?i)ALSO\s+PRESENT:", 1), (r"(?i)TAKEN\s+(?:ON|AT)\s+", 1), (r"(?i)PURSUANT\s+TO", 1),
    (r"(?m)^\s*Q[\.:]", -3), (r"(?m)^\s*A[\.:]", -3), (r"(?i)THE\s+WITNESS:", -2), (r"(?i)BY\s+(?:MR\.|MS\.|MRS\.)", -1),
]
TITLE_PAGE_SCORE = 4
TITLE_PAGES_LOOKED_AT = 3

# Sections and document types.
SECTION_PATTERNS = [
    (r"(FIRST|SECOND|THIRD|FOURTH|FIFTH)\s+CAUSE\s+OF\s+ACTION", "cause_of_action"), (r"COUNT\s+[IVX\d]+", "count"), (r"WHEREFORE", "wherefore"), (r"PRAYER\s+FOR\s+RELIEF", "prayer"),
    (r"STATEMENT\s+OF\s+FACTS", "facts"), (r"NATURE\s+OF\s+(THE\s+)?ACTION", "nature"), (r"PARTIES", "parties"), (r"JURISDICTION", "jurisdiction"), (r"AFFIRMATIVE\s+DEFENSES?", "affirmative_defenses"),
    (r"(FIRST|SECOND|THIRD|FOURTH|FIFTH)\s+AFFIRMATIVE\s+DEFENSE", "affirmative_defense"), (r"ANSWER", "answer"), (r"DENIALS?", "denials"), (r"DIRECT\s+EXAMINATION", "direct_examination"), (r"CROSS[- ]?EXAMINATION", "cross_examination"),
    (r"REDIRECT\s+EXAMINATION", "redirect_examination"), (r"(THE\s+)?WITNESS:", "witness_statement"), (r"BY\s+(MR\.|MS\.|MRS\.)\s+\w+:", "attorney_question"), (r"INTRODUCTION", "introduction"), (r"BACKGROUND", "background"), (r"ALLEGATIONS?", "allegations"),
]
DOC_TYPE_PATTERNS = [
    (r"COMPLAINT|PETITION|SUMMONS", "complaint"), (r"ANSWER\s+(TO|AND)|DEFENDANT.{0,20}ANSWER", "answer"), (r"DEPOSITION|TRANSCRIPT|EXAMINATION", "transcript"), (r"BILL\s+OF\s+PARTICULARS", "bill_of_particulars"), (r"MOTION|ORDER|RULING", "motion"),
]
# Beginnings of sections; the first pattern of the list that occurs names the section.
CHUNK_SECTION_PATTERNS = [
    r"^(STATEMENT OF|BACKGROUND|FACTS|FACTS AND|ARGUMENT|ARGUMENTS|CONCLUSION|CONCLUSIONS|DISCUSSION|RELIEF)",
    r"^[IVX]+\.\s+[A-Z]",
    r"^\d+\.\s+[A-Z]",
    r"^[A-Z][\.)]\s+[A-Z]",
    r"^[a-z][\.)]\s+[A-Z]",
    r"^Q[\:\.]",
    r"^QUESTION[\:\.]",
    r"^A[\:\.]",
    r"^ANSWER[\:\.]",
    r"^(THE\s+)?COURT[\:\.]",
    r"^(MR|MS|MRS|DR)\.\s+[A-Z]",
    r"^(THE\s+)?JUDGE[\:\.]",
    r"^={3,}",
    r"^-{3,}",
    r"^\*{3,}",
    r"^EXHIBIT\s+[A-Z0-9]",
    r"^[\[{0-9]+[\]}]",
    r"^PLAINTIFF",
    r"^DEFENDANT",
    r"^PETITIONER",
    r"^RESPONDENT",
    r"^RELIEF SOUGHT",
    r"^PRAYER FOR RELIEF",
    r"^WHEREFORE",
    r"^ALLEGATIONS",
    r"^COUNTS?",
    r"^CLAIM[S]?",
    r"^(January|February|March|April|May|June|July|August|September|October|November|December)\s+\d{1,2}",
    r"^\d{1,2}/\d{1,2}/\d{2,4}",
    r"^\d{4}-\d{2}-\d{2}",
    r"^(Morning|Afternoon|Evening) Session",
    r"^(Day\s+\d+|Deposition\s+on)",
]
SECTION_MAX_WORDS = 1000
BRIEF_TARGET, BRIEF_MAX, BRIEF_MIN = 1800, 2500, 500
SPLIT_SIZE, SPLIT_OVERLAP = 500, 50

# Vocabulary.
ALGORITHM_WEIGHTS = {"NER": 1.0, "BM25": 0.8, "RAKE": 0.7}
TYPE_PRECEDENCE = {"Person": 10, "Place": 9, "Medical": 8, "Organization": 7, "Technical": 5, "Unknown": 1}
TYPE_BOOST = {"Person": 10, "Place": 10, "Medical": 8, "Technical": 5, "Unknown": 0}
ORGANIZATION_WORDS = ["LLP", "PLLC", "P.C.", "LLC", "Inc", "Corp", "Corporation", "Law Firm", "Law Office", "Firm", "Hospital", "Medical", "Healthcare", "Health", "Clinic", "University", "College", "School", "Bank", "Insurance", "Services"]
RARE_RANK = 180_000
RAKE_MIN_SCORE, RAKE_MAX_PHRASES, RAKE_MAX_WORDS = 2.0, 150, 3
RAKE_JUNK_STARTS = ["the", "a", "an", "and", "or", "but", "of", "in", "on", "at", "to", "for"]
ML_MIN_SAMPLES, ML_RETRAIN_AFTER, ML_MIN_PER_CLASS = 30, 10, 3

# Acronyms that are titles or credentials, no terms.
TITLE_ACRONYMS = "MR MRS MS DR JR SR ESQ MD PHD RN DO PA NP DDS JD".split()

# Roles of persons: (pattern with the name in group 1, role), most specific first.
_NAME = r"([A-Z][a-zA-Z]+(?:\s+[A-Z][a-zA-Z]+)*)"
PERSON_ROLES = [
    (rf"(?i)plaintiff['s]?\s+(?:attorney|counsel|lawyer)\s+{_NAME}", "Plaintiff attorney"),
    (rf"(?i)defendant['s]?\s+(?:attorney|counsel|lawyer)\s+{_NAME}", "Defendant attorney"),
    (rf"(?i)plaintiff\s+{_NAME}", "Plaintiff"),
    (rf"(?i)defendant\s+{_NAME}", "Defendant"),
    (rf"(?i)treating\s+(?:physician|doctor)\s+{_NAME}", "Treating physician"),
    (rf"(?i)(?:Dr\.|Doctor)\s+{_NAME}", "Medical professional"),
    (rf"(?i){_NAME},?\s+(?:a|an)\s+(?:nurse|physician|surgeon|doctor|therapist)", "Medical professional"),
    (rf"(?i)witness\s+{_NAME}", "Witness"),
    (rf"(?i){_NAME}\s+testified", "Witness"),
    (rf"(?i){_NAME}\s+(?:was called as a|called to testify)", "Witness"),
]

# Briefings.
NAME_TITLES = r"\b(?:dr\.?|mr\.?|mrs\.?|ms\.?|md|jr\.?|sr\.?|esq\.?|iii|ii)\b"
CASE_TYPES = [
    ("medical malpractice", ["med mal", "medical negligence", "medical malpractice"]),
    ("personal injury", ["pi", "personal injury", "injury"]),
    ("negligence", ["negligence", "negligent"]),
    ("wrongful death", ["wrongful death", "death"]),
    ("breach of contract", ["breach of contract", "contract breach", "breach"]),
    ("premises liability", ["premises liability", "slip and fall", "premises"]),
    ("product liability", ["product liability", "defective product", "product defect"]),
    ("motor vehicle accident", ["mva", "car accident", "motor vehicle", "auto accident"]),
]
CATEGORY_ORDER = ["PARTY", "MEDICAL", "WITNESS", "OTHER"]
NAME_SIMILARITY, TEXT_SIMILARITY, MIN_ITEM_LENGTH = 0.85, 0.80, 10

# Questions and answers.
ANSWER_KEYWORDS = {
    "yes": ["yes", "court case", "legal proceeding", "lawsuit", "litigation"],
    "no": ["no", "not a court", "not related"],
    "criminal": ["criminal", "crime", "felony", "misdemeanor", "prosecution", "indictment"],
    "civil": ["civil", "plaintiff", "defendant", "lawsuit", "damages", "complaint"],
    "administrative": ["administrative", "agency", "regulatory", "board", "commission"],
}
MIN_RETRIEVAL_SCORE, RETRIEVAL_K = 0.1, 4
OCR_CONFIDENCE = 70
DIGITAL_CONFIDENCE, DIGITAL_LENGTH = 60, 1000

# Relevance of places: (pattern with the place in group 1, relevance), in order.
PLACE_ROLES = [
    (r"(?i)accident\s+(?:at|on|near)\s+([A-Z][a-zA-Z\s]+)", "Accident location"),
    (r"(?i)incident\s+(?:occurred|happened)\s+(?:at|on|near)\s+([A-Z][a-zA-Z\s]+)", "Incident location"),
    (r"(?i)collision\s+(?:at|on|near)\s+([A-Z][a-zA-Z\s]+)", "Collision location"),
    (r"(?i)(?:at|to|from|near)\s+([A-Z][a-zA-Z\s]+(?:Hospital|Medical Center|Clinic))", "Medical facility"),
    (r"(?i)([A-Z][a-zA-Z]+\s+[A-Z][a-zA-Z]+)\s+(?:Hospital|Medical Center|Clinic)", "Medical facility"),
    (r"(?i)surgery\s+(?:at|performed at)\s+([A-Z][a-zA-Z\s]+)", "Surgery location"),
    (r"(?i)treatment\s+(?:at|received at)\s+([A-Z][a-zA-Z\s]+)", "Treatment location"),
    (r"(?i)([A-Z][a-zA-Z]+(?:\s+[&,]\s+[A-Z][a-zA-Z]+)+)\s+(?:LAW FIRM|LLP|PC|PLLC)", "Law firm"),
    (r"(?i)([A-Z][a-zA-Z]+\s+[A-Z][a-zA-Z]+)\s+&\s+(?:[A-Z][a-zA-Z]+)", "Law firm"),
    (r"(?i)THE\s+([A-Z][a-zA-Z\s]+)\s+LAW FIRM", "Law firm"),
    (r"(?i)employed\s+(?:at|by)\s+([A-Z][a-zA-Z\s]+)", "Workplace"),
    (r"(?i)works\s+(?:at|for)\s+([A-Z][a-zA-Z\s]+)", "Workplace"),
]

# Entities that are no vocabulary: fragments of addresses, of documents and legal
# boilerplate, found anywhere; the last one, a case citation, at the start.
ENTITY_FILTERS = [
    r"\d+(?:st|nd|rd|th)\s+Floor", r"\b(?:Street|Drive|Avenue|Road|Lane|Court|Boulevard|Place|Way)\b", r"^\d+\s+[A-Z]", r"^(?:SUPREME|CIVIL|FAMILY|DISTRICT)\s+COURT", r"^NOTICE\s+OF",
    r"Attorneys?\s+for\s+(?:Plaintiff|Defendant)", r"Services?\s+-\s+(?:Plaintiff|Defendant|None)", r"^(?:Plaintiff|Defendant)(?:'s)?$", r"^(?:FIRST|SECOND|THIRD|FOURTH|FIFTH)\s+CAUSE", r"^\d+\s+of\s+\d+$",
    r"Verified\s+(?:Bill|Answer|Complaint|Petition)", r"Notice\s+of\s+Commencement", r"Cause\s+of\s+Action", r"Honorable\s+Court", r"Answering\s+Defendant", r"^[A-Z][a-zA-Z]+\s+v\.?\s+[A-Z][a-zA-Z]+$",
]
WORD_FILTERS = [
    r"^[a-z]+\(s\)$", r"^[a-z]+s\(s\)$", r"^[a-z]+\([a-z]+\)$", r"^[a-z]+'s$", r"^[a-z]+-[a-z]+$", r"^[A-Za-z]+-[A-Z][a-z]", r"^.*[0-9][A-Za-z]{2,}[0-9]",
    r"^[A-Z]{2,}\s+(?:SS|§)\s*\d+", r"^\w+\s+Law\s+(?:SS|§)\s*\d+", r"^\d+\s+[A-Z]+\s+\d+", r"^[A-Z]{2,}\s+\d+", r"^\d{5}(?:-\d{4})?$", r"^[A-Z]{2}\s+\d{5}$",
]
CATEGORY_NAMES = {"PARTY": "Parties", "MEDICAL": "Medical Personnel", "WITNESS": "Witnesses", "OTHER": "Other Individuals"}
