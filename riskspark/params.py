"""Model parameters. Small tables of published constants, no logic beyond lookups.

Everything in the blocks marked "fixed values" must equal the published methodology for the
results to agree.
"""

from __future__ import annotations

from dataclasses import dataclass, field

# --- fixed values: indicator weights (sum 100) -------------------------------------------
WEIGHTS = {
    "liquidity": 40.0,
    "compliance": 10.0,
    "budget_exec": 15.0,
    "coverage": 0.0,
    "autonomy": 15.0,
    "arrears": 20.0,
}

# --- fixed values: quality rating --------------------------------------------------------
RATING_FACTORS = {"A": 1.00, "B": 0.95, "C": 0.90, "D": 0.85, "E": 0.80}
RATING_CUTS = [("A", 0.95), ("B", 0.85), ("C", 0.75), ("D", 0.65)]
RATING_FLOOR = "E"
NO_RATING = "SEM_ICF"
NO_RATING_FACTOR = 0.80
STATUS_FINAL = "FINAL"
STATUS_PRELIMINARY = "PREVIO_OFICIAL"

# --- fixed values: risk classes, safest first --------------------------------------------
RISK_CLASSES = ["🟢 Risco Baixo", "🟡 Risco Médio", "🔴 Risco Alto", "⛔ Crítico"]
NO_DATA_CLASS = "⚫ Sem Dados"
BACKTEST_CLASSES = ["BAIXO", "MEDIO", "ALTO", "CRITICO"]
BACKTEST_NO_DATA = "SEM_DADOS"
SCORE_CUTS = (75.0, 55.0, 35.0)
BACKTEST_CUTS = (80.0, 60.0, 40.0)
CHRONIC_YEARS_CAP = 4

# --- fixed values: thresholds ------------------------------------------------------------
CHRONIC_ARREARS_PCT = 3.0
SUSPECT_LIQUIDITY = -0.50
LARGE_ENTITY_POPULATION = 50_000
DELAY_WINDOW_LARGE = 90
DELAY_WINDOW_SMALL = 210
UNKNOWN_DELAY_DAYS = 999
PARTIAL_LIQUIDITY_PENALTY = -5.0
PENALTY_FLOOR = -10.0
CONTRACT_VALUE_CAP = 8_000_000_000.0
DIRECT_AWARD_ALERT = 0.30
RECENCY_WEIGHTS = (0.40, 0.25, 0.20, 0.10, 0.05)
BACKTEST_RECENCY_WEIGHTS = (40.0, 25.0, 20.0, 10.0, 5.0)
ARREARS_CURVE = (1.00, 0.75, 0.50, 0.30, 0.10)

# --- fixed values: last month of each reporting period by regime -------------------------
PERIOD_END_MONTH = {
    ("Q", 1): 4,
    ("Q", 2): 8,
    ("Q", 3): 12,
    ("S", 1): 6,
    ("S", 2): 12,
}

# --- fixed values: macro-region of each state --------------------------------------------
REGIONS = {
    "NORTE": ["AC", "AM", "AP", "PA", "RO", "RR", "TO"],
    "NORDESTE": ["AL", "BA", "CE", "MA", "PB", "PE", "PI", "RN", "SE"],
    "CENTRO_OESTE": ["DF", "GO", "MS", "MT"],
    "SUDESTE": ["ES", "MG", "RJ", "SP"],
    "SUL": ["PR", "RS", "SC"],
}
STATE_REGION = {state: region for region, states in REGIONS.items() for state in states}

# --- fixed values: state of each two-digit entity code prefix ----------------------------
CODE_PREFIX_STATE = {
    "11": "RO", "12": "AC", "13": "AM", "14": "RR", "15": "PA", "16": "AP", "17": "TO",
    "21": "MA", "22": "PI", "23": "CE", "24": "RN", "25": "PB", "26": "PE", "27": "AL",
    "28": "SE", "29": "BA",
    "31": "MG", "32": "ES", "33": "RJ", "35": "SP",
    "41": "PR", "42": "SC", "43": "RS",
    "50": "MS", "51": "MT", "52": "GO", "53": "DF",
}
FEDERAL_DISTRICT_QUERY_ID = "53"
FEDERAL_DISTRICT_CODE = "5300108"
FEDERAL_DISTRICT_INSTITUTION = "Governo do Distrito Federal"

# --- fixed values: autonomy sigmoid midpoint by region and size tier; slope by tier ------
SIZE_TIERS = [("micro", 10_000), ("pequeno", 50_000), ("médio", 200_000), ("grande", None)]
SIGMOID_SLOPE = {"micro": 98.6, "pequeno": 77.9, "médio": 96.2, "grande": 306.2}
SIGMOID_MIDPOINT = {
    "NORDESTE": {"micro": 0.0296, "pequeno": 0.0276, "médio": 0.0318, "grande": 0.0228},
    "NORTE": {"micro": 0.0314, "pequeno": 0.0293, "médio": 0.0337, "grande": 0.0242},
    "CENTRO_OESTE": {"micro": 0.0444, "pequeno": 0.0414, "médio": 0.0476, "grande": 0.0342},
    "SUL": {"micro": 0.0463, "pequeno": 0.0432, "médio": 0.0498, "grande": 0.0357},
    "SUDESTE": {"micro": 0.0390, "pequeno": 0.0364, "médio": 0.0419, "grande": 0.0300},
}
CRITICAL_AUTONOMY = {
    "NORDESTE": 0.0500,
    "NORTE": 0.0530,
    "CENTRO_OESTE": 0.0750,
    "SUL": 0.0780,
    "SUDESTE": 0.0660,
}

# --- fixed values: severity and text of each compliance requirement ----------------------
REQUIREMENTS = [
    ("req_previdenciaria_rpps", "1.1", "Regularidade Previdenciária (RPPS)", "LEVE"),
    ("req_fiscal_rfb", "1.2", "Regularidade Fiscal (RFB)", "GRAVE"),
    ("req_pgfn", "1.3", "Regularidade PGFN", "GRAVE"),
    ("req_fgts", "1.4", "Regularidade FGTS", "MODERADA"),
    ("req_trabalhista_tst", "1.5", "Regularidade Trabalhista (TST)", "MODERADA"),
    ("req_lrf_pessoal_exec", "2.1.1", "LRF - Limite Pessoal Executivo", "GRAVE"),
    ("req_lrf_pessoal_leg", "2.1.2", "LRF - Limite Pessoal Legislativo", "MODERADA"),
    ("req_siops", "3.1.1", "SIOPS (Saúde)", "MODERADA"),
    ("req_siops_demo", "3.1.2", "SIOPS Demonstrativo", "LEVE"),
    ("req_siope", "3.2.1", "SIOPE (Educação)", "MODERADA"),
    ("req_siope_demo", "3.2.2", "SIOPE Demonstrativo", "LEVE"),
    ("req_siope_compl", "3.2.3", "SIOPE Complementar", "LEVE"),
    ("req_siope_obs", "3.2.4", "SIOPE Observações", "LEVE"),
    ("req_siga", "3.3", "SIGA (Alimentação Escolar)", "LEVE"),
    ("req_siconv_pc", "3.4.1", "SICONV/TRANSFEREGOV Prestação de Contas", "MODERADA"),
    ("req_siconv_debitos", "3.4.2", "SICONV/TRANSFEREGOV Débitos", "LEVE"),
    ("req_cadin", "3.5", "CADIN", "GRAVE"),
    ("req_tcu", "3.6", "Adimplência TCU", "GRAVE"),
    ("req_cgu", "3.7", "Adimplência CGU", "GRAVE"),
    ("req_sistn_divida", "4.1", "SISTN (Dívida Consolidada)", "GRAVE"),
    ("req_sistn_garantias", "4.2", "SISTN (Garantias)", "MODERADA"),
    ("req_siconfi_rreo", "5.1", "SICONFI RREO", "LEVE"),
    ("req_siconfi_rgf", "5.2", "SICONFI RGF", "LEVE"),
    ("req_siconfi_balanco", "5.3", "SICONFI Balanço Anual", "LEVE"),
    ("req_siconfi_dca", "5.4", "SICONFI DCA", "LEVE"),
    ("req_siconfi_pcasp", "5.5", "SICONFI PCASP", "LEVE"),
    ("req_siconfi_dcasp", "5.6", "SICONFI DCASP", "LEVE"),
    ("req_siconfi_mcasp", "5.7", "SICONFI MCASP", "LEVE"),
]
REQUIREMENT_COLUMNS = [r[0] for r in REQUIREMENTS]
SEVERITY_RANK = {"GRAVE": 1, "MODERADA": 2, "LEVE": 3}

# --- fixed values: account rules, patterns on lower-case labels --------------------------
BUDGET_RULES = {
    # measure: (annex prefix, account codes, column pattern, account-name pattern)
    "revenue_realized": (
        "RREO-Anexo 01", ["ReceitasExcetoIntraOrcamentarias"],
        r"^at. o bimestre \(c\)$", None),
    "revenue_planned": (
        "RREO-Anexo 01", ["ReceitasExcetoIntraOrcamentarias"],
        r"^previs.o atualizada \(a\)$", None),
    "expense_settled": (
        "RREO-Anexo 01", ["TotalDespesas"],
        r"^despesas liquidadas at. o bimestre \(h\)$", None),
    "unprocessed_arrears": (
        "RREO-Anexo 07", ["RestosAPagarNaoProcessadosAPagar"],
        r"^saldo k = \(f ?\+ ?g\) - \(i ?\+ ?j\)$", r"^total \(iii\) = \(i \+ ii\)$"),
    "processed_arrears": (
        "RREO-Anexo 07",
        ["RestosAPagarProcessadosENaoProcessadosLiquidadosAPagar",
         "RestosAPagarProcessadosENaoProcessadosLiquidadosAPagarIntra"],
        r"^saldo e = \(a ?\+ ?b\) - \(c ?\+ ?d\)$", r"^total \(iii\) = \(i \+ ii\)$"),
}
CASH_AFTER = "DisponibilidadeDeCaixaLiquidaAposRP"
CASH_BEFORE = "DisponibilidadeDeCaixaLiquida"
TOTAL_IV = r"^total \(iv\) = \(i \+ ii \+ iii\)$"
TOTAL_III = r"^total \(iii\) = \(i \+ ii\)$"
PENSION_TOTAL = r"^total dos recursos vinculados ao rpps \(iii\)$"
FISCAL_ANNEX = "RGF-Anexo 05"
FISCAL_RULES = {
    "cash_after_iv": (FISCAL_ANNEX, [CASH_AFTER], None, TOTAL_IV),
    "cash_after_iii": (FISCAL_ANNEX, [CASH_AFTER], None, TOTAL_III),
    "cash_after_pension": (FISCAL_ANNEX, [CASH_AFTER], None, PENSION_TOTAL),
    "cash_before_iv": (FISCAL_ANNEX, [CASH_BEFORE], None, TOTAL_IV),
    "cash_before_iii": (FISCAL_ANNEX, [CASH_BEFORE], None, TOTAL_III),
    "cash_before_pension": (FISCAL_ANNEX, [CASH_BEFORE], None, PENSION_TOTAL),
}

# --- fixed values: text parsing ----------------------------------------------------------
NULL_TOKENS = ["nan", "None", "NaT", "<NA>"]
SERVING_NULL_TOKENS = ["NaN", "nan", "None", "none", "inf", "-inf"]
TRUE_TOKENS = ["true", "1", "t", "yes", "y", "sim"]
FALSE_TOKENS = ["false", "0", "f", "no", "n", "nao", "não"]
NO_NUMBER_TOKENS = ["", "-", "NA", "N/A"]
BUDGET_REPORT_KEYWORDS = [
    ("relatorio resumido de execucao orcamentaria simplificado", "RREO Simplificado"),
    ("rreo simplificado", "RREO Simplificado"),
    ("relatorio resumido de execucao orcamentaria", "RREO"),
    ("rreo", "RREO"),
]
FISCAL_REPORT_KEYWORDS = [
    ("relatorio de gestao fiscal simplificado", "RGF Simplificado"),
    ("rgf simplificado", "RGF Simplificado"),
    ("relatorio de gestao fiscal", "RGF"),
    ("rgf", "RGF"),
]
FISCAL_PLANS_SMALL = [("RGF Simplificado", "S"), ("RGF", "S"), ("RGF Simplificado", "Q"), ("RGF", "Q")]
FISCAL_PLANS_LARGE = [("RGF", "Q"), ("RGF Simplificado", "Q"), ("RGF", "S"), ("RGF Simplificado", "S")]

# --- fixed values: rival official credit grade -> ordinal risk ---------------------------
GRADE_RISK = {"A+": 0, "A": 1, "B+": 2, "B": 3, "C": 4}
GRADE_RISK_WITH_D = {**GRADE_RISK, "D": 5}
GRADE_RISK_UNGRADED_HIGH = {**GRADE_RISK_WITH_D, "N.D.": 5, "N.E.": 5}

# --- fixed values: wording of the validation report --------------------------------------
STRONG, MODERATE, WEAK, POOR = "forte", "moderado", "fraco", "baixo"
READ_TOO_SMALL = "amostra insuficiente para leitura confiavel"
READ_AUC_ONLY = "leitura baseada apenas em discriminacao binaria"
READ_CORRELATION_ONLY = "leitura baseada apenas em correlacao ordinal"
READ_CONSISTENT = "score ordena bem o risco futuro e discrimina de forma consistente"
READ_CLEAR = "score tem sinal claro e desempenho moderado"
READ_LIMITED = "score tem algum sinal, mas com discriminacao limitada"
READ_UNSTABLE = "score apresenta sinal fraco ou instavel"
BASE_COMPLETE, BASE_TOTAL = "Era completa", "Total"


@dataclass(frozen=True)
class StateOverride:
    """Partial replacement of the defaults for one state."""

    weights: dict[str, float] = field(default_factory=dict)
    critical_autonomy: float | None = None
    sigmoid: dict[str, tuple[float, float]] = field(default_factory=dict)


def region_of(state: str) -> str:
    key = state.strip().upper()
    if key not in STATE_REGION:
        raise ValueError(f"state without a region: {state!r}")
    return STATE_REGION[key]


def state_rows(overrides: dict[str, StateOverride] | None = None) -> list[dict]:
    """One row per state with every parameter that may vary by state (27 rows)."""
    overrides = overrides or {}
    rows = []
    for state in sorted(STATE_REGION):
        own = overrides.get(state, StateOverride())
        region = STATE_REGION[state]
        row = {"state": state, "region": region}
        for name, weight in {**WEIGHTS, **own.weights}.items():
            row[f"w_{name}"] = float(weight)
        limit = own.critical_autonomy
        row["critical_autonomy"] = CRITICAL_AUTONOMY[region] if limit is None else float(limit)
        for tier, slope in SIGMOID_SLOPE.items():
            mid, k = own.sigmoid.get(tier, (SIGMOID_MIDPOINT[region][tier], slope))
            row[f"mu_{tier}"] = float(mid)
            row[f"k_{tier}"] = float(k)
        rows.append(row)
    return rows

# years that may stand in an entity's grid; lines outside are counted, not shown
GRID_YEARS = (1900, 2199)
