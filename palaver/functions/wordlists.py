"""Word lists and patterns that results depend on."""

# French stop words (public Snowball list, plus "ça").
FRENCH_STOPWORDS = """
au aux avec ce ces dans de des du elle en et eux il je la le leur lui ma mais me même mes moi mon
ne nos notre nous on ou par pas pour qu que qui sa se ses son sur ta te tes toi ton tu un une vos
votre vous
c d j l à m n s t y
été étée étées étés étant suis es est sommes êtes sont serai seras sera serons serez seront serais
serait serions seriez seraient étais était étions étiez étaient fus fut fûmes fûtes furent sois soit
soyons soyez soient fusse fusses fût fussions fussiez fussent
ayant eu eue eues eus ai as avons avez ont aurai auras aura aurons aurez auront aurais aurait aurions
auriez auraient avais avait avions aviez avaient eut eûmes eûtes eurent aie aies ait ayons ayez aient
eusse eusses eût eussions eussiez eussent
ceci cela celà cet cette ici ils les leurs quel quels quelle quelles sans soi ça
""".split()

# Literal phrases that mark a possibly grateful comment.
PRAISE_LITERALS = [
    "merci",
    "intéressant",
    "passionant",
    "enrichissant",
    "pertinent",
    "clair",
    "limpide",
    "détaillé",
    "fascinant",
    "sourcé",
    "expliqué",
    "pédagogique",
    "éclairant",
    "de qualité",
    "commentaire",
    "article",
    "remarque",
    "explication",
    "éclaircissement",
    "clarification",
    "argumentation",
    "argumentaire",
    "point de vue",
    "bon sens",
    "recommandation",
    "sources",
    "référence",
    "superbe",
    "excellent",
    "magnifique",
    "très bon",
    "AJA",
    "appris",
    "coucherai moins bête",
    "savais pas",
    "connaissais pas",
    "comprends mieux",
    "enfin compris",
    "mieux dit",
    "dit mieux",
    "bien dit",
]

# The patterns used beside the literals.
PRAISE_PATTERNS = [
    "constructi(f|ve)",
    "instructi(f|ve)",
    r"\Wpost\W",
    "(bon|beau) (travail|boulot)",
    r"super\W",
]

# Sentences a praising comment is compared with.
PRAISE_SENTENCES = [
    "Merci, très intéressant.",
    "Merci pour cette réponse claire et instructive.",
    "Merci pour ce commentaire clair et instructif.",
    "Merci pour cette argumentation détaillée, c'est intéressant.",
    "Réponse intéressante, merci.",
    "Explication claire et intéressante.",
    "Excellente réponse, merci.",
    "Excellent commentaire, merci.",
    "Merci, c'est un point de vue intéressant.",
]

# Flairs of social and political threads, and the wider set used for topics.
SOCIOPOLITICAL_FLAIRS = ["Politique", "Science", "Société", "Écologie", "Économie"]
TOPIC_FLAIRS = ["Société", "Politique", "Économie", "News", "Science", "Écologie"]

# Bodies that stand for "no text".
NO_TEXT = ["[deleted]", "[removed]", "[supprimé]"]
