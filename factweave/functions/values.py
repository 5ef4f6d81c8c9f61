"""Word lists, patterns and constants that results depend on, as they are, with what each is for."""

from __future__ import annotations

# Words that carry no content in a question, English and Russian.
ENGLISH_STOPWORDS = [
    "a", "about", "above", "after", "again", "against", "all", "am", "an", "and", "any", "are", "aren't", "as", "at", "be", "because", "been", "before", "being", "below", "between", "both", "but", "by",
    "can", "can't", "could", "couldn't", "did", "didn't", "do", "does", "doesn't", "doing", "don't", "down", "during", "each", "few", "for", "from", "further", "had", "hadn't", "has", "hasn't", "have",
    "haven't", "having", "he", "her", "here", "hers", "herself", "him", "himself", "his", "how", "if", "in", "into", "is", "isn't", "it", "its", "itself", "me", "more", "most", "my", "myself", "no", "nor",
    "not", "of", "off", "on", "once", "only", "or", "other", "our", "ours", "ourselves", "out", "over", "own", "same", "she", "should", "so", "some", "such", "than", "that", "the", "their", "theirs",
    "them", "themselves", "then", "there", "these", "they", "this", "those", "through", "to", "too", "under", "until", "up", "very", "was", "were", "what", "when", "where", "which", "while", "who", "whom",
    "why", "with", "would", "you", "your", "yours", "yourself",
]
RUSSIAN_STOPWORDS = [
    "и", "в", "во", "не", "что", "он", "на", "я", "с", "со", "как", "а", "то", "все", "она", "так", "его", "но", "да", "ты", "к", "у", "же", "вы", "за", "бы", "по", "только", "ее", "мне", "было", "вот", "от",
    "меня", "еще", "ещё", "нет", "о", "об", "из", "ему", "теперь", "когда", "даже", "ну", "ли", "если", "уже", "или", "ни", "быть", "был", "него", "до", "вас", "опять", "уж", "вам", "ведь", "там", "потом",
    "себя", "ничего", "ей", "может", "они", "тут", "где", "есть", "надо", "ней", "для", "мы", "тебя", "им", "их", "чем", "при", "без", "раз", "тоже", "также", "это", "эта", "эти", "этот", "этого", "этом",
    "того", "том", "тем", "чтобы", "который", "которая", "которые", "которых", "которой", "были", "будет", "будут", "была", "можно", "очень", "более", "менее", "после", "перед", "между", "через", "под",
    "над", "про", "куда", "откуда", "здесь", "кто", "какой", "какая", "какие", "какое", "сколько", "почему", "зачем",
]
STOPWORDS = ENGLISH_STOPWORDS + RUSSIAN_STOPWORDS

# What a question asks for.
NAME_WORDS = "name|names|who|people|person|persons|имя|имена|имен|фамили|фамилия|фамилии|кто|люди|человек|персон|упомянут|упомянута|упомянуты"
TEMPORAL_WORDS = r"year|years|when|date|period|duration|timeline|how\s+long|год|года|году|годы|лет|когда|дата|период|срок|длительность"
QUANTITY_WORDS = r"how\s+many|how\s+much|percent|percentage|number|count|total|average|median|rate|сколько|процент|процентов|число|количество|сумм|средн|медиан|показател"
TECHNICAL = (
    r"мг/л|mg/l|мг/дм|mg/dm|ppm|г/л|g/l|≤|≥|<|>|concentration|retention\s+time|de-?zn|zinc\s+removal|coral\s+bay|оптимальн|скорост[\p{L}\p{N}_]*\s+поток|технико-эконом|распределени|содержани|извлечен|концентрац|"
    r"сухой\s+остаток|обессолив|католит|электроэкстракц|штейн|шлак|мпг|pgm|precious|flow\s+rate|desalination|electrowinning|catholyte|ph\s*range"
)
TECHNICAL_WORDS = "ph"
EXPERIMENT_LIST = r"покажите\s+все|все\s+эксперимент|все\s+публикац|list\s+all|show\s+all\s+experiment"
COMPARISON_WORDS = r"compare|comparison|versus|vs\.?|difference|differences|between|both\s+documents|each\s+other|сравн|разниц|отличи|между|оба\s+документ"
AGGREGATE_WORDS = r"all\s+documents|every\s+document|each\s+document|across\s+all|all\s+reports|all\s+articles|all\s+sources|every\s+report|все\s+документ|каждом\s+документ|по\s+всем\s+документ|всех\s+документ"
HARM_TERMS = ["harm", "damage", "overcharge", "hurt", "loss", "вред", "ущерб", "убыт", "переплат", "затрат", "потер", "убытк"]
DOMESTIC_MARKERS = ["росси", "russia", "отечеств", "domestic", "cis"]
INTERNATIONAL_MARKERS = ["international", "global", "abroad", "зарубеж", "миров"]
TITLE_STOPWORDS = ["the", "and", "for", "from", "with", "about", "article", "report", "study", "документ", "статья", "отчет", "отчёт", "материал"]
SPELLING = {"sulphuric": "sulfuric", "sulphur": "sulfur", "sulphate": "sulfate", "aluminium": "aluminum", "artefact": "artifact"}
SHORT_TERMS = ["ph", "zn", "ni", "cu", "au", "ag", "fe", "al", "co", "mg", "na", "ca", "hpal", "hcl", "h2so4", "ppm"]

# Numbers with units, chemical symbols, pages and years in a text.
NUMERIC_ANCHOR = r"\d+(?:[.,]\d+)?(?:\s*[-–—]\s*\d+(?:[.,]\d+)?)?(?:\s*(?:мг/л|mg/l|мг/дм³?|mg/dm³?|%|°c|℃|м/ч|м³/ч|m3/h|мм/с))?"
CHEMICAL = "Ca|Mg|Na|Ni|Cu|Au|Ag|Fe|Al|Zn|Co|SO4|Cl|H2SO4|pH|сульфат|хлорид|никел|мед|золот|серебр"
NUMBER = r"\d+(?:[.,]\d+)?"
UNITS = r"мг/л|mg/l|мг/дм|mg/dm|ppm|%|°c|℃|м/ч|м³/ч|m3/h|мм/с|т/год|t/y|t/a|usd|\$|руб|млн|million|billion|tonnes?|tonne"
YEAR = r"(?:19|20)\d{2}"
REFERENCE_MARKERS = ["references", "bibliography", "литература", "библиограф", "источник"]
STAT_LINE = r"\d+(?:[.,]\d+)?\s*(?:million|billion)?\s*(?:tonnes?|tons?|t/y|t/a|mt)"

# Answers that say that the sources do not suffice.
HEDGES = [
    r"not possible to determine", r"cannot determine", r"can't determine", r"unable to (?:answer|determine|conclude)", r"insufficient (?:information|context|data|evidence)",
    r"does not (?:contain|provide|address|include)", r"do not (?:contain|provide|address|include)", r"not enough information", r"no (?:specific|sufficient|direct) (?:information|details|data)",
    r"more information .{0,40} (?:needed|required|necessary)", r"what is missing", r"based on the (?:given |provided )?context,? it is not", r"the excerpts do not", r"context does not",
    r"недостаточно информации", r"не содержат достаточно", r"не удалось определить", r"невозможно определить",
]

# Context windows of a compressed chunk.
SYNONYMS = {
    "global production": ["worldwide", "produced worldwide", "world production"],
    "world production": ["worldwide", "produced worldwide", "global production"],
    "million tonnes": ["million tons", "million tonne", "mt"],
    "million tons": ["million tonnes", "million ton", "mt"],
}
NO_MATERIAL = ["according", "paper", "page", "current", "what", "when", "where", "global", "production", "million", "tonnes", "tons", "tonne", "ton", "world", "worldwide", "about", "year", "years"]

# Canonical key, Russian and English name of known terms.
GLOSSARY = {
    "nickel": ("никель", "nickel"), "copper": ("медь", "copper"), "cobalt": ("кобальт", "cobalt"), "iron": ("железо", "iron"), "zinc": ("цинк", "zinc"), "magnesium": ("магний", "magnesium"),
    "manganese": ("марганец", "manganese"), "aluminum": ("алюминий", "aluminum"), "gold": ("золото", "gold"), "silver": ("серебро", "silver"), "platinum": ("платина", "platinum"), "palladium": ("палладий", "palladium"),
    "sulfur": ("сера", "sulfur"), "gypsum": ("гипс", "gypsum"), "limonite": ("лимонит", "limonite"), "matte": ("матт", "matte"), "slag": ("шлак", "slag"), "concentrate": ("концентрат", "concentrate"), "ore": ("руда", "ore"),
    "hydrochloric_acid": ("соляная кислота", "hydrochloric acid"), "sulfuric_acid": ("серная кислота", "sulfuric acid"), "h2so4": ("серная кислота", "H2SO4"), "hcl": ("соляная кислота", "HCl"),
    "beneficiation": ("обогащение", "beneficiation"), "flotation": ("флотация", "flotation"), "leaching": ("выщелачивание", "leaching"), "heap_leaching": ("кучное выщелачивание", "heap leaching"),
    "hpal": ("автоклавное выщелачивание", "HPAL"), "hydrometallurgy": ("гидрометаллургия", "hydrometallurgy"), "hydrometallurgical_processing": ("гидрометаллургическая переработка", "hydrometallurgical processing"),
    "pyrometallurgy": ("пирометаллургия", "pyrometallurgy"), "roasting": ("обжиг", "roasting"), "smelting": ("плавка", "smelting"), "refining": ("рафинирование", "refining"),
    "electrorefining": ("электрорафинирование", "electrorefining"), "electrolytic_refining": ("электролитическое рафинирование", "electrolytic refining"), "electrowinning": ("электроосаждение", "electrowinning"),
    "precipitation": ("осаждение", "precipitation"), "oxidation": ("окисление", "oxidation"), "autoclave_oxidation": ("автоклавное окисление", "autoclave oxidation"), "carbonyl_nickel": ("карбонильный никель", "carbonyl nickel"),
    "precious_metals": ("драгоценные металлы", "precious metals"), "ore_raw_material": ("рудное сырье", "ore raw material"), "magnesium_chloride": ("хлорид магния", "magnesium chloride"),
    "limonite_ore": ("лимонитовая руда", "limonite ore"), "fe2o3": ("Fe2O3", "Fe2O3"), "coral_bay": ("coral bay", "Coral Bay"), "zinc_removal": ("удаление цинка", "zinc removal"), "de_zn": ("de-zn", "De-Zn"),
    "finite_element_method": ("метод конечных элементов", "finite element method"), "finite_stiffness_links": ("связи конечной жесткости", "finite stiffness links"), "numerical_modeling": ("численное моделирование", "numerical modeling"),
    "geotechnical_modeling": ("геотехническое моделирование", "geotechnical modeling"), "verification_modeling": ("верификационное моделирование", "verification modeling"), "cfd_simulation": ("CFD-моделирование", "CFD simulation"),
    "field_testing": ("полевые испытания", "field testing"), "laboratory_testing": ("лабораторные испытания", "laboratory testing"), "geotechnical_analysis": ("геотехнический анализ", "geotechnical analysis"),
    "model_calibration": ("калибровка модели", "model calibration"), "static_analysis": ("статический расчет", "static analysis"), "dynamic_analysis": ("динамический расчет", "dynamic analysis"),
    "fem_simulation": ("МКЭ-моделирование", "FEM simulation"), "structural_analysis": ("расчет конструкций", "structural analysis"), "rock_mechanics_testing": ("испытания механики горных пород", "rock mechanics testing"),
}

# Places of a geography filter; query parameters that do not name a page; hosts that are not taken in.
DOMESTIC = ["domestic", "russia", "ru", "россия", "российск"]
DOMESTIC_COUNTRIES = ["russia", "ru", "россия"]
INTERNATIONAL = ["international", "global", "foreign", "abroad"]
INTERNATIONAL_SCOPES = ["international", "global"]
TRACKING = ["utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "fbclid", "gclid", "mc_cid", "mc_eid"]
BLOCKED_HOSTS = ["example.com", "www.example.com", "example.org", "www.example.org", "localhost", "127.0.0.1"]

# Kinds of names (see classify).
KEEP_AS_MATERIAL = [
    "rock", "soil", "clay", "sand", "gravel", "granite", "basalt", "limestone", "steel", "concrete", "water", "ice", "snow", "permafrost", "nickel", "copper", "iron", "ore",
    "гранит", "глина", "песок", "скала", "порода", "бетон", "сталь", "cement", "цемент",
]
SUBSTANCE_NOUNS = [
    "ore", "concentrate", "tailings", "feed", "feedstock", "water", "gas", "reagent", "catalyst", "solvent", "powder", "sample", "specimen", "rock", "soil", "clay", "sand", "steel", "concrete",
    "руда", "концентрат", "хвосты", "реагент", "катализатор", "растворитель", "порошок", "образец", "проба", "вода", "газ", "скала", "порода", "глина", "песок", "сталь", "бетон",
]
APPARATUS = [
    "reactor", "vessel", "tank", "pump", "filter", "compressor", "furnace", "boiler", "kiln", "column", "chamber", "module", "instrument", "apparatus", "device", "machine", "sensor", "detector", "probe", "rig",
    "burner", "motor", "turbine", "baffle", "partition", "roof", "vault", "shaft", "stack", "chimney", "stage",
    "реактор", "сосуд", "бак", "насос", "фильтр", "компрессор", "печь", "котел", "котёл", "колонна", "камера", "модуль", "прибор", "аппарат", "установка", "агрегат", "устройство", "машина", "датчик", "стенд",
    "горелка", "перегородка", "свод", "шахта", "конденсатор", "теплообменник",
]
FACILITIES = ["plant", "site", "facility", "laboratory", "lab", "complex", "campus", "field", "завод", "лаборатория", "комплекс", "площадка", "объект", "цех"]
ACTIVITIES = [
    "mining", "extraction", "beneficiation", "enrichment", "closure", "processing", "smelting", "refining", "roasting", "leaching", "flotation", "grinding",
    "добыча", "обогащение", "обогащения", "закрытие", "переработка", "плавка", "флотация", "измельчение", "выщелачивание", "обжиг", "рафинирование",
]
MATERIAL_HEADS = ["отходы", "хвосты", "waste", "tailings", "residue", "residues", "slag", "шлак", "раствор", "solution", "cement", "цемент", "ore", "руда", "concentrate", "концентрат"]
PARAMETERS = [
    "temperature", "pressure", "density", "ph", "duration", "concentration", "viscosity", "conductivity", "hardness", "porosity", "moisture", "nickel_content", "copper_content", "iron_content", "recovery_rate",
    "yield_strength", "tensile_strength", "melting_point", "particle_size", "температура", "давление", "плотность", "концентрация", "прочность",
]
BUSINESS_WORDS = [
    "associates", "associate", "group", "holdings", "partners", "consulting", "services", "corporation", "company", "limited", "resources", "mining", "metals", "platinum", "nickel", "international", "global",
    "american", "gmbh", "corp", "inc", "ltd", "plc",
]
OPERATION_STEMS = [
    "cool", "heat", "dry", "test", "measur", "calibr", "analyz", "analys", "model", "simulat", "extract", "separ", "purif", "mix", "stir", "grind", "wash", "rinse", "monitor", "characteriz", "evaluat",
    "охлажд", "нагрев", "суш", "испыт", "измер", "калибр", "анализ", "моделир", "экстрак", "раздел", "очист", "смеш", "монитор",
]
OPERATION_ENDINGS = [
    "ing", "tion", "sion", "ment", "sis", "ysis", "ization", "isation", "ение", "ания", "ения", "ание", "ние", "ция", "овка", "ировка", "тие", "ие",
]
CONCEPTS = [
    "model", "simulation", "simulat", "methodolog", "calibrat", "integrat", "efficien", "stiffness", "modulus", "equivalent", "geometry", "geometric", "tectonic", "fracture", "fault", "global", "computational",
    "numerical", "algorithm", "workflow", "framework", "section", "модел", "симуля", "моделир", "методик", "калибр", "интеграц", "эффективн", "жесткост", "модуль", "эквивалент", "геометри", "тектонич", "разлом",
    "глобальн", "вычислит", "численн", "алгоритм", "сечени", "участк", "брус", "жёсткост", "жестк",
]
MEASURED_ENDINGS = ["strength", "density", "pressure", "stress", "strain", "stiffness", "modulus", "area", "прочност", "плотност", "напряжен", "деформац", "площад", "жесткост", "модуль"]
MINES = ["mine", "deposit", "quarry", "pit", "field", "рудник", "карьер"]
MINE_STEM = "месторожд"
GENERIC_CLASSES = [
    "ore", "mineral", "concentrate", "intermediate", "metal", "alloy", "solution", "reagent", "compound", "composite", "ceramic", "polymer", "other", "feed", "feedstock", "product", "engineering", "processing",
    "beneficiation", "solid", "liquid", "powder", "film", "substance", "material", "feed concentrate", "flotation concentrate",
]
MATERIAL_CLASSES = ["other", "mineral", "ore", "concentrate", "intermediate", "compound", "reagent", "solution", "metal", "alloy", "composite", "ceramic", "polymer"]
CLASS_ALIASES = {
    "liquid": "solution", "stainless_steel": "alloy", "stainless": "alloy", "steel": "alloy", "process": "other", "feed": "concentrate", "tailings": "intermediate", "matte": "intermediate", "slag": "intermediate",
    "electrolyte": "solution", "leachate": "solution", "liquor": "solution", "catholyte": "solution", "anolyte": "solution", "precipitate": "intermediate", "salt": "compound", "carbonate": "compound",
    "sulfate": "compound", "sulphate": "compound", "refractory": "ceramic", "ptfe": "polymer", "teflon": "polymer",
}
REGIMES = ["heat_treatment", "mechanical", "chemical", "thermomechanical", "other"]
REGIME_ALIASES = {
    "leaching": "chemical", "heap_leaching": "chemical", "heap leaching": "chemical", "hydrometallurgy": "chemical", "hydro": "chemical", "electrowinning": "chemical", "electrorefining": "chemical", "refining": "chemical",
    "roasting": "heat_treatment", "smelting": "heat_treatment", "pyrometallurgy": "heat_treatment", "pyro": "heat_treatment", "flotation": "mechanical", "beneficiation": "mechanical", "grinding": "mechanical",
    "crushing": "mechanical", "milling": "mechanical", "mining": "mechanical", "heat": "heat_treatment", "heat treatment": "heat_treatment", "annealing": "heat_treatment", "quenching": "heat_treatment",
    "tempering": "heat_treatment", "forging": "thermomechanical", "rolling": "thermomechanical", "extrusion": "thermomechanical",
}
REGIME_HINTS = {"chemical": ["leach", "hydro", "electro", "refin", "acid", "alkali"], "heat_treatment": ["smelt", "roast", "pyro", "furnace", "temperature"], "mechanical": ["grind", "crush", "float", "mill", "beneficiat"]}

# Labels of properties.
PROPERTY_LABELS = {
    "nickel_content": ("Nickel content", "Содержание никеля"), "cobalt_content": ("Cobalt content", "Содержание кобальта"), "copper_content": ("Copper content", "Содержание меди"),
    "iron_content": ("Iron content", "Содержание железа"), "magnesium_content": ("Magnesium content", "Содержание магния"), "total_content": ("Total content", "Общее содержание"),
    "nickel_extraction": ("Nickel extraction", "Извлечение никеля"), "cobalt_extraction": ("Cobalt extraction", "Извлечение кобальта"), "magnesium_extraction": ("Magnesium extraction", "Извлечение магния"),
    "copper_extraction": ("Copper extraction", "Извлечение меди"), "recovery_rate": ("Recovery rate", "Степень извлечения"), "extraction_rate": ("Extraction rate", "Степень извлечения"), "yield": ("Yield", "Выход"),
    "density": ("Density", "Плотность"), "ph": ("pH", "pH"), "temperature": ("Temperature", "Температура"), "concentration": ("Concentration", "Концентрация"), "flow_rate": ("Flow rate", "Расход"),
}

# Pages, headings, captions and pictures.
SECTION_NAMES = ["введение", "заключение", "результаты", "обсуждение", "методы", "материалы", "литература", "аннотация", "abstract", "introduction", "conclusion", "references"]
SECTION_STARTS = ["1.", "2.", "3.", "I.", "II."]
CAPTION_MARKS = ["рис.", "figure", "fig.", "фиг."]
IMAGE_TYPES = {
    "microstructure": ["микроструктур", "microstructure", "sem", "tem", "оптик"],
    "plot": ["график", "зависимост", "chart", "graph", "крив"],
    "scheme": ["схем", "диаграмм", "scheme", "diagram", "flowsheet"],
    "table": ["табл", "table"],
}
REFUSALS = [
    "не могу обсуждать", "не могу говорить", "не буду обсуждать", "давайте поговорим о чём-нибудь", "давайте поговорим о чем-нибудь", "i can't discuss", "i cannot discuss", "can't help with that",
    "cannot help with that", "as an ai language model",
]
OVERFLOWS = ["exceed_context_size", "exceeds the available context size", "context length exceeded", "maximum context length"]
TABLE_HINT = r"table\s*\d+|таблица\s*\d+|tabular"
TABLE_BLOCK = r"(?is)\[TABLE\].*?\[/TABLE\]"

# Phrases that name a process, with the process's key; the glossary's processes; words of a process's label.
PROCESS_PHRASES = [
    (r"метод\s+конечн(?:ых|ого|ой)\s+элемент|мкэ|mkэ|finite\s+element", "finite_element_method"),
    (r"связ(?:и|ь)\s+конечн(?:ой|ых)\s+ж[её]сткост", "finite_stiffness_links"),
    (r"численн(?:ое|ые|ая|ый)?\s+(?:моделир|расч|исслед|анализ)", "numerical_modeling"),
    (r"моделир(?:ование|овани)?\s+(?:тектон|разлом|геотех|скал|пород|брус|конструкц)", "geotechnical_modeling"),
    (r"верификационн(?:ая|ое|ые|ый)?\s+модел", "verification_modeling"),
    (r"вычислительн(?:ая|ые|ое|ый)?\s+гидродинамик", "cfd_simulation"),
    (r"полев(?:ые|ое|ая|ой)?\s+(?:испытан|исследован|наблюден|работ)", "field_testing"),
    (r"лабораторн(?:ые|ое|ая|ой)?\s+(?:испытан|исследован|эксперимент)", "laboratory_testing"),
    (r"геотехнич(?:еск(?:ие|ое|ая|ий)|ески)\s+(?:расч|модел|исслед)", "geotechnical_analysis"),
    (r"калибров(?:ка|ки|очн)?\s+модел", "model_calibration"),
    (r"статическ(?:ий|ая|ое|ие)\s+(?:расч|анализ)", "static_analysis"),
    (r"охлажден(?:ие|ия|ию|ии)?\s+(?:печ|реактор|котел|котёл|установк)", "furnace_cooling"),
    (r"динамическ(?:ий|ая|ое|ие)\s+(?:расч|анализ|модел)", "dynamic_analysis"),
]
PROCESS_WORDS = {"fem": "finite_element_method", "cfd": "cfd_simulation"}
PROCESS_KEYS = [
    "beneficiation", "flotation", "leaching", "heap_leaching", "hpal", "hydrometallurgy", "hydrometallurgical_processing", "pyrometallurgy", "roasting", "smelting", "refining", "electrorefining",
    "electrolytic_refining", "electrowinning", "precipitation", "oxidation", "autoclave_oxidation", "zinc_removal", "de_zn", "finite_element_method", "finite_stiffness_links", "numerical_modeling",
    "geotechnical_modeling", "verification_modeling", "cfd_simulation", "field_testing", "laboratory_testing", "geotechnical_analysis", "model_calibration", "static_analysis", "dynamic_analysis", "fem_simulation",
    "structural_analysis", "rock_mechanics_testing",
]
PROCESS_HINTS = [
    "simulation", "modeling", "modelling", "analysis", "calibration", "testing", "experiment", "survey", "monitoring", "drilling", "sampling", "leaching", "flotation", "smelting", "refining", "finite", "element",
    "stiffness", "fem", "cfd", "моделир", "расчет", "расчёт", "анализ", "испытан", "исследован", "выщелач", "флотац", "плавк", "рафинир", "обогащ", "бурени", "отбор", "мониторинг", "калибров", "метод", "элемент",
    "мкэ", "жесткост",
]
# Words of a prompt that are no entities.
TEMPLATES = [
    "short label", "process or theme", "one grounded sentence", "linked process name if any", "canonical material name", "substance name", "organization name", "person name", "site name", "equipment name",
    "process name", "team name", "company name", "institute name", "facility name", "researcher name", "название материала", "название организации", "краткое описание", "example", "sample", "n/a", "na", "none",
    "unknown", "tbd", "todo",
]
PLACEHOLDERS = {
    "equipment": ["equipment", "device", "unit", "apparatus", "machine", "tool", "оборудование", "устройство", "установка"],
    "process": ["process", "operation", "technology", "procedure", "method", "процесс", "операция", "технология", "метод"],
    "topic": ["topic", "theme", "subject", "area", "тема", "направление"],
    "field": ["field", "discipline", "specialty", "area", "область", "специальность"],
}
RELIABILITY = {"article": 0.92, "report": 0.88, "patent": 0.85, "thesis": 0.80, "other": 0.70}
# Phrases that name an experiment, numbers that stand in the text with their unit, words of an experiment's label, headers of properties.
EXPERIMENT_PHRASES = [
    (r"верификационн[\p{L}\p{N}_]*\s+модел", "verification_model"),
    (r"расчетн[\p{L}\p{N}_]*\s+(?:модел|схем|задач)", "computational_model"),
    (r"численн[\p{L}\p{N}_]*\s+(?:эксперимент|расчет|расчёт|моделир|исслед)", "numerical_experiment"),
    (r"моделирование\s+(?:тектон|разлом|ослаблен|брус|конечн|упруг)", "geotechnical_simulation"),
    (r"полев[\p{L}\p{N}_]*\s+(?:испытан|эксперимент|исследован)", "field_experiment"),
    (r"лабораторн[\p{L}\p{N}_]*\s+(?:испытан|эксперимент)", "laboratory_experiment"),
    (r"статическ[\p{L}\p{N}_]*\s+(?:расчет|расчёт|анализ|испытан)", "static_test"),
    (r"динамическ[\p{L}\p{N}_]*\s+(?:расчет|расчёт|анализ|испытан)", "dynamic_test"),
]
INLINE_NUMBERS = {
    "elastic_modulus": (r"(?:модуль\s+)?(?:упругости|Young(?:'s)?(?:\s+modulus)?|E)\s*[=:]\s*([\d.,]+)\s*(MPa|GPa|kPa|Pa|МПа|ГПа)?", "MPa"),
    "poisson_ratio": (r"(?:коэфф\.?\s+)?(?:Пуассона|Poisson(?:'s)?|ν)\s*[=:]\s*([\d.,]+)()", ""),
    "density": (r"(?:плотност[\p{L}\p{N}_]*|density)\s*[=:]\s*([\d.,]+)\s*(kg/m3|kg/m³|g/cm3|g/cm³)?", "kg/m3"),
}
EXPERIMENT_HINTS = [
    "model", "simulation", "experiment", "study", "analysis", "verification", "calculation", "computational", "numerical", "test", "run", "case", "модел", "эксперимент", "расчет", "расчёт", "верификац", "численн",
    "испытан", "исследован", "анализ", "схем",
]

#: Words that tell no material; words of processes by the stage of a material's class; processes that a material's name hints at.
MATERIAL_TERM_STOP = ["and", "the", "of", "for", "raw", "materials", "material", "ore", "metal"]
STAGE_WORDS = {
    "feedstock": ["mining", "beneficiation", "flotation", "heap", "leaching"],
    "beneficiation": ["beneficiation", "flotation", "concentrate"],
    "processing": ["pyrometallurgy", "smelting", "roasting", "leaching", "hydro", "electrowinning"],
    "product": ["refining", "electrowinning"],
    "engineering": ["water", "treatment", "recycling", "waste"],
}
NAME_HINTS = {
    "catholyte": ["electrowinning", "electro"],
    "anolyte": ["electrowinning", "electro"],
    "matte": ["pyrometallurgy", "smelting"],
    "slag": ["pyrometallurgy", "smelting"],
    "gypsum": ["leaching", "hydro", "waste", "water", "recycling"],
    "sulfate": ["electrowinning", "refining", "nickel", "cobalt"],
    "nickel": ["nickel", "refining", "electrowinning", "cobalt"],
    "copper": ["copper", "smelting", "refining"],
    "rom": ["mining", "beneficiation", "heap", "leaching"],
    "concentrate": ["flotation", "beneficiation", "smelting"],
}

#: Kinds of facilities that an answer may name.
FACILITY_TYPES = ["plant", "mine", "smelter", "refinery", "laboratory", "site"]

#: Shapes of a chemical formula and of a year; shapes of a person's name: initials and surname, surname and initials, surname comma name, two or three capitalised words.
FORMULA = r"^[A-Z][a-z]?\d*(?:[A-Z][a-z]?\d*|\([A-Z][a-z]?\d*\)\d*)+$"
YEAR_LABEL = r"(?iu)^(?:19|20)\d{2}(?:\s*(?:year|yr|г\.?|год))?$"
PERSON_SHAPES = [
    r"^[A-Z][a-zA-Z\-']+(?:\s+[A-Z]\.){0,2}\s+[A-Z][a-zA-Z\-']+$",
    r"^[А-ЯЁ][а-яё\-]+(?:\s+[А-ЯЁ][а-яё\-]+){1,3}$",
    r"^[А-ЯЁ]\.\s*[А-ЯЁ]\.\s*[А-ЯЁ][а-яё\-]+$",
    r"^[А-ЯЁ][а-яё\-]+\s+[А-ЯЁ]\.\s*(?:[А-ЯЁ]\.\s*)?$",
]
AUTHOR_SHAPES = [
    r"^[A-Z]\.\s*(?:[A-Z]\.\s*)?[A-Z][a-zA-Z\-']+(?:\s+[A-Z][a-zA-Z\-']+)?$",
    r"^[А-ЯЁ][а-яё\-]+\s+[А-ЯЁ]\.\s*[А-ЯЁ]\.?$",
    r"^[А-ЯЁ]\.\s*[А-ЯЁ]\.\s*[А-ЯЁ][а-яё\-]+(?:-[А-ЯЁ][а-яё\-]+)?$",
]
#: Words of matter, plants, work and sections, which no person is called (without those of particular sites and firms).
NO_PERSON_WORDS = [
    "nickel", "copper", "iron", "zinc", "cobalt", "gold", "silver", "platinum", "magnesium", "manganese", "aluminum", "aluminium", "lead", "tin", "chromium",
    "matte", "slag", "gypsum", "sulfate", "sulphate", "chloride", "hydroxide", "catholyte", "anolyte", "electrolyte", "concentrate", "tailings", "ore",
    "leaching", "flotation", "electrowinning", "refining", "smelting", "roasting", "crusher", "reactor", "furnace", "circuit", "heap", "treatment", "removal",
    "water", "mine", "plant", "mill", "cell", "tank", "pump", "filter", "institute", "university", "laboratory", "department", "division", "company",
    "mining", "metallurgy", "metallurgical", "hydrometallurgy", "pyrometallurgy",
    "facility", "facilities", "auxiliary", "site", "condition", "conditions", "project", "information", "management", "equipment", "procurement",
    "overview", "summary", "introduction", "conclusion", "abstract", "contents", "appendix", "section", "chapter", "maintenance", "construction", "design",
    "engineering", "performance", "evaluation", "assessment", "background", "objective", "scope", "schedule", "safety", "environmental", "inventory",
    "supply", "control", "monitoring", "system", "systems", "operation", "operations", "processing", "precipitation", "extraction", "recovery",
    "pressure", "high", "low", "acid", "alkaline", "neutral", "waste", "disposal", "storage", "handling", "transport", "logistics",
    "commissioning", "startup", "shutdown", "reagent", "reagents", "catalyst",
    "никель", "медь", "железо", "цинк", "шлак", "гипс", "руда", "концентрат", "институт", "университет", "лаборатория", "завод", "комбинат", "рудник",
    "объект", "площадка", "проект", "оборудование", "процесс", "установка",
]
#: Marks of slides and sections, marks of institutions and legal forms, roles, and what a name of an institution looks like.
NOISE_MARKS = [
    "presentation", "презентация", "powerpoint", "microsoft", "slide", "slides", "figure", "fig.", "рис.", "таблица", "table", "chart", "diagram", "график",
    "copyright", "©", "confidential", "конфиденциаль", "abstract", "introduction", "conclusion", "references", "bibliography", "acknowledgement", "acknowledgment", "appendix",
    "аннотация", "введение", "заключение", "литература", "содержание", "contents", "agenda", "outline", "summary", "page ", "страница", "стр.",
]
INSTITUTION_MARKS = [
    "institute", "university", "laboratory", "laborat", "academy", "college", "research", "department", "division", "faculty", "school", "hospital", "center", "centre", "foundation", "company", "corporation", "consortium",
    "институт", "университет", "лаборатор", "академ", "департамент", "факультет", "центр", "завод", "фгбу", "комбинат", "llc", "ltd", "inc", "corp", "gmbh", "ооо", "пао", "ао", "гмк", "рао",
]
AFFILIATION_MARKS = ["institute", "university", "laboratory", "department", "институт", "университет", "лаборатор"]
ROLE_WORDS = [
    "researcher", "scientist", "engineer", "manager", "director", "specialist", "consultant", "professor", "associate", "assistant", "coordinator", "senior", "junior", "lead", "head", "chief", "principal",
    "исследователь", "инженер", "менеджер", "директор", "специалист", "консультант", "профессор", "ассистент", "руководитель", "эксперт",
]
INSTITUTION_SHAPE = r"(?iu)ПАО|ГМК|АО|ООО|LLC|Ltd\.?|Inc\.?|Corp\.?|GmbH|University|Institute|Laboratory|Лаборатория|Институт|ФГБУ|«[^»]{4,80}»"
LEGAL_NAME = r"(?iu)ООО\s*«[^»]+»"
NAME_DELIMITERS = r"(?iu)[;,/]|(?:\s+and\s+)|(?:\s+и\s+)|\s{2,}"
#: Labels of lines with authors and with institutions; names in a list, with a role after a dash or alone; headings of rosters; lines of a page's head that are no names.
AUTHOR_LABELS = [
    r"(?iu)(?:Авторы?|Authors?|Докладчик(?:и)?|Presenter(?:s)?)\s*:?\s*([^\n]+)",
    r"(?iu)(?:Подготовил[аи]?|Prepared by)\s*:?\s*([^\n]+)",
    r"(?iu)(?:Исполнител(?:ь|и)|Составител(?:ь|и)|Разработал(?:и)?|Developed by)\s*:?\s*([^\n]+)",
    r"(?iu)(?:Ответственный\s+исполнитель|Научный\s+руководитель|Руководитель\s+(?:работ|проекта))\s*:?\s*([^\n]+)",
    r"(?iu)(?:Corresponding\s+author|Contact\s+author)\s*:?\s*([^\n]+)",
]
HEADER_LABELS = [r"(?iu)(?:Authors?|Author|By|Докладчик(?:и)?|Presenter(?:s)?)\s*:?\s*([^\n]+)", r"(?iu)(?:Авторы?)\s*:?\s*([^\n]+)"]
INSTITUTION_LABELS = [
    r"(?iu)(?:Организация|Organization|Affiliation|Место работы|Учреждение)\s*:?\s*([^\n]+)",
    r"(?iu)(ООО\s*«[^»]+»)",
    r"(?iu)((?:ПАО|ГМК|АО)\s*«?[^»\n]{4,100}»?)",
    r"(?iu)((?:Институт|Institute|University|Laboratory|Лаборатория)[^\n]{3,120})",
]
_LISTED_NAME = r"([А-ЯЁ][а-яё\-]+(?:\s+[А-ЯЁ][а-яё\-]+){1,3}|[A-Z][a-zA-Z\-']+(?:\s+[A-Z]\.){0,2}\s+[A-Z][a-zA-Z\-']+)"
ROSTER_ITEM = rf"(?:\d+\.\s*)?{_LISTED_NAME}\s*[–\-—]"
NUMBERED_NAME = rf"(?m)^\s*\d+\.\s*{_LISTED_NAME}\s*$"
ROSTER_HEADING = (
    r"(?iu)(?:^|\n)\s*(?:Experts?(?:\s+of\s+the\s+project)?|Эксперты?(?:\s+проекта)?|Список\s+экспертов|Project\s+team|Team\s+members?|Команда(?:\s+проекта)?|Участники(?:\s+проекта)?"
    r"|Исполнител(?:ь|и)|Составител(?:ь|и)|Ответственный\s+исполнитель|Научный\s+руководитель|Руководитель\s+(?:работ|проекта))\s*[:：]?\s*(?:\n|$)"
)
NO_AUTHOR_LINE = r"(?i)^(?:abstract|introduction|references|figure|table|page\s+\d+|страница\s+\d+|\d+\s*$|contents|appendix|overview|summary|discussion|conclusion|acknowledgement)"
#: Persons in running text: two names, or three with a father's name between; words that no surname is; words of a person's role; what is said of one.
TWO_NAMES = r"([A-Z][a-z\x{00C0}-\x{024F}]{2,}\s+[A-Z][a-z\x{00C0}-\x{024F}]{2,}|[А-ЯЁ][а-яё]{1,}\s+[А-ЯЁ][а-яё]{1,})"
THREE_NAMES = r"((?iu:[A-Z][a-z\x{00C0}-\x{024F}]{2,}\s+[A-Z][a-z\x{00C0}-\x{04FF}]{3,}(?:ovich|evich|ovna|evna)\s+[A-Z][a-z\x{00C0}-\x{04FF}]{2,}|[А-ЯЁ][а-яё]{1,}\s+[А-ЯЁ][а-яё]{3,}(?:ович|евич|овна|евна|ич|на)\s+[А-ЯЁ][а-яё]{1,}))"
#: Parts of names that are no person's, and ends of patronymics, after which a surname is missing.
NO_NAME_PARTS = ["Birch", "Russia", "Russian"]
PATRONYMIC_ENDS = ["ovich", "evich"]
NO_SURNAMES = [
    "Tree", "House", "World", "Council", "Centre", "Center", "Regions", "Landscape", "Grove", "Steel", "Life", "Love", "Park", "Affairs", "Society", "Foundation", "Institute", "Holding", "Office", "Federation",
    "Poetics", "Security", "Russian", "Creative", "Trade", "Film", "Federal", "Ethnic", "Presidential", "Foreign", "Media", "Geographical", "Regional", "Internet", "Development", "Down", "Upside", "Young", "Silk", "Mamayev",
    "Kurgan", "Volgograd", "Moscow", "National", "Peoples", "Countries", "Frontline", "Forest", "Ensemble", "Academy", "Presidium", "Board", "Session", "Festival", "Exposition", "Designers", "Capsule", "Mos", "Kino",
    "Economics", "Economic", "Industrial", "Organization", "Machine", "Learning", "Letters", "Theory", "Studies", "Modelling", "Modeling", "Psychology", "Software", "Product", "Transparency", "Capacities",
    "Fluctuation", "Detection", "References", "Statistical", "Political", "Demand", "Homogenous", "Applied", "Market", "Production",
    "Российский", "Российская", "Российское", "Федерации", "Федерация", "Области", "Регион", "Регионы", "Академии", "Университет",
]
ROLE_HINTS = [
    "moderator", "soloist", "artist", "presenter", "journalist", "academician", "member", "organiser", "organizer", "author", "poet", "performed", "said", "noted", "people's artist", "people artist",
    "модератор", "солист", "художник", "журналист", "академик", "автор", "поэт", "сказал", "сказала", "отметил", "отметила", "заявил", "подчеркнул", "выступил", "народный", "артист", "участник", "докладчик",
]

#: Labels whose nodes are merged by name, and those that are shown only where they fit themselves.
MERGED_LABELS = ("Material", "Process", "Equipment", "Facility", "Property", "Expert", "Team", "ProcessingRegime")
SIDE_LABELS = ("Equipment", "Facility", "FigureGallery", "Expert", "Team", "Document")
#: What a typed question is looked through for.
QUERY_PROCESSES = [
    "electrowinning", "электролиз", "leaching", "выщелачивание", "heap leach", "flotation", "флотация", "smelting", "плавка", "flash smelting", "desalination", "обессоливание",
    "catholyte", "католит", "circulation", "циркуляция", "pyrometallurgy", "пирометаллургия", "hydrometallurgy", "гидрометаллургия",
]
QUERY_MATERIALS = [
    "nickel", "никель", "copper", "медь", "cathode", "катод", "matte", "матт", "slag", "шлак", "sulfate", "сульфат", "chloride", "хлорид", "gypsum", "гипс", "pgm", "gold", "silver", "золото", "серебро", "electrolyte", "электролит",
]
QUERY_PROPERTIES = ["concentration", "концентрация", "flow rate", "расход", "temperature", "температура", "yield", "выход", "recovery", "извлечение", "dry residue", "сухой остаток"]
QUERY_STOP = [
    "what", "has", "been", "done", "on", "under", "and", "the", "for", "was", "were", "effect", "how", "does", "affect", "with", "in", "of", "to", "is", "are", "already", "about", "show", "me", "find",
    "give", "good", "main", "points", "from", "your", "that", "this", "какие", "какой", "какая", "что", "где", "при", "для", "или", "все",
]

#: Headers of a table's columns that hold a property, with its unit; parts of other headers that tell one; parts of the header of the column that names a row.
HEADER_PROPERTIES = {
    "e": ("elastic_modulus", "MPa"), "e mpa": ("elastic_modulus", "MPa"), "e, mpa": ("elastic_modulus", "MPa"), "e (mpa)": ("elastic_modulus", "MPa"), "young's modulus": ("elastic_modulus", "MPa"),
    "youngs modulus": ("elastic_modulus", "MPa"), "модуль упругости": ("elastic_modulus", "MPa"), "модуль e": ("elastic_modulus", "MPa"), "ν": ("poisson_ratio", ""), "nu": ("poisson_ratio", ""), "v": ("poisson_ratio", ""),
    "poisson ratio": ("poisson_ratio", ""), "коэффициент пуассона": ("poisson_ratio", ""), "пуассона": ("poisson_ratio", ""), "density": ("density", "kg/m3"), "плотность": ("density", "kg/m3"),
    "g": ("shear_modulus", "MPa"), "shear modulus": ("shear_modulus", "MPa"), "модуль сдвига": ("shear_modulus", "MPa"),
}
ROW_HEADERS = ["zone", "зона", "material", "материал", "участок", "region", "область", "element", "элемент"]
