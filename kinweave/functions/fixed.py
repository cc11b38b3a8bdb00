"""Word lists, patterns and labels of the Spanish-language data.

They are defaults only. Every operator takes its dictionary as a parameter.
"""

WIKI = "https://es.wikipedia.org/wiki/"

# Columns that hold relation text.
RELATION_FIELDS = ["padres", "conyuge", "pareja", "hijos", "hermanos"]
PROFILE_PREFIX = "perfiles_relacionados_"
SPOUSE_RELATIONS = ["conyuge", "pareja"]

# Inverse of each relation.
INVERSE_RELATION = {
    "padres": "hijos",
    "hijos": "padres",
    "conyuge": "conyuge",
    "pareja": "pareja",
    "hermanos": "hermanos",
}

# Tokens dropped before a surname is read, and tokens that are no surname.
NAME_PARTICLES = ["de", "del", "la", "los", "las", "y", "e"]
NOT_SURNAMES = ["chile", "argentina", "actor", "comediante", "político"]
SURNAME_ARTICLES = ["de", "del", "la", "los", "las"]

# Words that mark a relation entry as a heading, not a person.
KIN_WORDS = ["familia", "nupcias"]

# Letters folded to ASCII.
FOLD_FROM = "áàâäãåéèêëíìîïóòôöõúùûüñçý"
FOLD_TO = "aaaaaaeeeeiiiiooooouuuuncy"

# Country keywords, first country with a hit wins.
COUNTRY_KEYWORDS = {
    "argentina": ["argentina", "buenos aires", "córdoba", "rosario", "argentino"],
    "chile": ["chile", "santiago", "valparaíso", "chileno", "chilena"],
    "mexico": ["méxico", "mexico", "ciudad de méxico", "guadalajara", "mexicano", "mexicana"],
    "peru": ["perú", "peru", "lima", "peruano", "peruana"],
    "colombia": ["colombia", "bogotá", "medellín", "colombiano", "colombiana"],
    "venezuela": ["venezuela", "caracas", "venezolano", "venezolana"],
    "bolivia": ["bolivia", "la paz", "boliviano", "boliviana"],
    "paraguay": ["paraguay", "asunción", "paraguayo", "paraguaya"],
    "uruguay": ["uruguay", "montevideo", "uruguayo", "uruguaya"],
    "ecuador": ["ecuador", "quito", "guayaquil", "ecuatoriano", "ecuatoriana"],
}

# Nationality tiers (declared name, birthplace, demonym in the biography).
NATIONALITY_TIERS = {
    "declared": {
        "Chile": ["chile"],
        "Argentina": ["argentina"],
        "México": ["méxico"],
        "Perú": ["perú"],
        "Colombia": ["colombia"],
        "Venezuela": ["venezuela"],
        "Bolivia": ["bolivia"],
        "Paraguay": ["paraguay"],
        "Uruguay": ["uruguay"],
        "Ecuador": ["ecuador"],
    },
    "birthplace": {
        "Chile": ["santiago", "chile", "valparaíso", "concepción", "viña del mar"],
        "Argentina": ["buenos aires", "córdoba", "rosario", "argentina", "mendoza"],
        "México": ["ciudad de méxico", "méxico", "guadalajara", "monterrey", "puebla"],
        "Perú": ["lima", "perú", "cusco", "arequipa", "trujillo"],
        "Colombia": ["bogotá", "colombia", "medellín", "cali", "cartagena", "barranquilla"],
        "Venezuela": ["caracas", "venezuela", "maracaibo", "valencia"],
        "Bolivia": ["la paz", "bolivia", "santa cruz", "sucre", "cochabamba"],
        "Paraguay": ["asunción", "paraguay", "encarnación"],
        "Uruguay": ["montevideo", "uruguay", "paysandú"],
        "Ecuador": ["quito", "guayaquil", "ecuador", "cuenca"],
    },
    "demonym": {
        "Chile": ["chileno", "chilena"],
        "Argentina": ["argentino", "argentina"],
        "México": ["mexicano", "mexicana"],
        "Perú": ["peruano", "peruana"],
        "Colombia": ["colombiano", "colombiana"],
        "Venezuela": ["venezolano", "venezolana"],
        "Bolivia": ["boliviano", "boliviana"],
        "Paraguay": ["paraguayo", "paraguaya"],
        "Uruguay": ["uruguayo", "uruguaya"],
        "Ecuador": ["ecuatoriano", "ecuatoriana"],
    },
}

# The same tiers for the two-country study.
PAIR_TIERS = {
    "declared": {"Chile": ["chilen"], "Argentina": ["argentin"]},
    "birthplace": {
        "Chile": ["santiago", "chile", "valparaíso", "concepción"],
        "Argentina": ["buenos aires", "córdoba", "rosario", "argentina"],
    },
    "demonym": {
        "Chile": ["chileno", "chilena"],
        "Argentina": ["argentino", "argentina"],
    },
}

# Patterns that tie a person to a target country.
TARGET_PATTERNS = {
    "Argentina": [
        "embajador.*argentina", "ministro.*argentina", "diplomático.*argentina",
        "argentino", "buenos aires", "menem", "perón",
    ],
    "Chile": [
        "embajador.*chile", "ministro.*chile", "diplomático.*chile",
        "chileno", "chilena", "santiago.*chile",
    ],
    "México": [
        "embajador.*méxico", "ministro.*méxico", "diplomático.*méxico",
        "mexicano", "mexicana", "ciudad de méxico",
    ],
    "Perú": [
        "embajador.*perú", "ministro.*perú", "diplomático.*perú",
        "peruano", "peruana", "lima",
    ],
}

# Kind of link by the text field that names the other country.
LINK_KIND = {
    "lugar_fallecimiento": "fallecimiento",
    "residencia": "residencia",
    "lugar_nacimiento": "nacimiento",
    "cargos_politicos": "trabajo",
    "ocupacion": "trabajo",
    "biografia_inicial": "biografía",
}

# Office type, first match wins.
OFFICE_TYPES = [
    ("presidente", "Presidente"),
    ("ministro", "Ministro"),
    ("senador", "Senador"),
    ("diputado", "Diputado"),
    ("gobernador", "Gobernador"),
    ("alcalde", "Alcalde"),
    ("embajador", "Embajador"),
    ("general|almirante", "Militar"),
    ("juez|tribunal", "Judicial"),
]

# Office flags, not exclusive.
OFFICE_FLAGS = {
    "es_presidente": "presidente",
    "es_ministro": "ministro",
    "es_senador": "senador",
    "es_diputado": "diputado",
    "es_gobernador": "gobernador",
    "es_alcalde": "alcalde",
    "es_embajador": "embajador",
    "es_militar": "general|almirante|militar",
}

# Patterns of the office profile.
PROFILE_PATTERNS = {
    "embajador": "embajador|ambassador",
    "ministro": "ministro|minister",
    "presidente": "presidente|president",
    "diplomatico": "diplomático|diplomatico|diplomat",
    "politico": "político|politico|politic",
}

# Infobox labels that open an office.
OFFICE_HEADERS = [
    "Presidente", "Senador", "Diputado", "Ministro", "Alcalde", "Intendente", "Gobernador",
    "Embajador", "Subsecretario", "Concejal", "Consejero", "Director", "Rector", "Decano",
]

# Birthplace regions of the geography table, first match wins.
POWER_REGIONS = [
    ("santiago|valparaíso|viña|concepción", "Capital/Región Central"),
    ("valdivia|temuco|puerto montt|osorno", "Sur"),
    ("la serena|coquimbo|antofagasta|iquique|arica", "Norte"),
]

# Family groups by name, first match wins.
FAMILY_GROUPS = [
    ("aylwin", "Aylwin"),
    ("huidobro|garcía-huidobro|garcia-huidobro", "García-Huidobro"),
    ("bello", "Bello"),
    ("balmaceda", "Balmaceda"),
    ("edwards", "Edwards"),
    ("alessandri", "Alessandri"),
    ("saavedra", "Saavedra"),
    ("alpoim|alpoin", "Alpoim"),
    ("zuviría|zuviria|gorriti", "Zuviría/Gorriti"),
    ("belzu|belzú", "Belzu"),
    ("fortabat|lacroze", "Fortabat"),
    ("amoedo", "Amoedo"),
    ("lafuente", "Lafuente"),
    ("otálora|otalora", "Otálora"),
    ("anchorena", "Anchorena"),
    ("restrepo", "Restrepo"),
    ("lleras", "Lleras"),
    ("santos", "Santos"),
    ("lópez", "López"),
    ("ospina", "Ospina"),
    ("tovar", "Tovar"),
    ("toro(?!nis)", "Toro"),
    ("bolívar|bolivar", "Bolívar"),
    ("machado", "Machado"),
    ("zuloaga", "Zuloaga"),
    ("planas", "Planas"),
]

# Families of interest per country.
FAMILIES_OF_INTEREST = {
    "chile": [
        "aylwin", "huidobro", "bello", "saavedra", "balmaceda",
        "garcía-huidobro", "garcia-huidobro", "edwards", "alessandri",
    ],
    "argentina": ["otálora", "otalora", "saavedra", "anchorena"],
    "colombia": ["restrepo", "lleras", "santos", "lópez", "ospina"],
    "venezuela": ["tovar", "toro", "bolívar", "bolivar", "machado", "zuloaga", "planas"],
}

# Edges added by hand between persons found by name.
CURATED_EDGES = [
    ("cornelio saavedra", "saturnina.*otálora|saturnina.*otalora", "conyuge"),
    (
        "saturnina.*otálora|saturnina.*otalora",
        "josé antonio gregorio de otálora|jose antonio gregorio de otalora",
        "padres",
    ),
]

# Word lists of the visibility table.
VISIBILITY_WORDS = {
    "nombres": [
        "maría", "rosa", "ana", "elena", "patricia", "carmen", "teresa", "andrea", "paula",
        "carolina", "josefina", "isabel", "luisa", "mercedes", "dolores", "francisca",
        "claudia", "mónica", "verónica", "natalia",
    ],
    "ocupaciones": ["primera dama", "esposa", "ama de casa", "dama"],
    "dependiente": ["esposa de"],
    "propias": ["política", "abogada", "médica", "profesora", "escritora", "artista"],
}
VISIBILITY_LABELS = ("Femenino", "Masculino/Desconocido")

# Link targets that are no person page.
NON_PERSON_LINKS = [
    "/wiki/Ayuda:", "/wiki/Archivo:", "/wiki/Especial:", "/wiki/Plantilla:",
    "/wiki/Portal:", "/wiki/Categor%C3%ADa:", "/wiki/Familia_",
]
FAMILY_LIST_INCLUDE = ["Familia"]
FAMILY_LIST_EXCLUDE = ["Fundadoras"]

# Period and cohort bands (upper bounds are exclusive).
PERIOD_BANDS = ([1973, 1990], ["Pre-1973", "Dictadura (1973-1990)", "Post-dictadura (1990+)"])
GENERATION_BANDS = ([1900, 1950, 1980], ["Pre-1900", "1900-1950", "1950-1980", "1980+"])
VISIBILITY_BANDS = ([1950, 1980], ["Pre-1950", "1950-1980", "1980+"])

# Columns written by the attribute merge, with their types.
MERGED_ATTRIBUTES = {
    "cargo_1": "text",
    "cargo_2": "text",
    "cargo_3": "text",
    "partido_limpio": "text",
    "nacimiento_ano": "int",
    "fallecimiento_ano": "int",
    "hijos_lista": "list",
    "conexion_otros_paises": "text",
    "redes_dentro_pais": "text",
    "redes_entre_paises": "text",
}
