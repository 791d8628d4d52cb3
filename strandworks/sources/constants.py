"""Known artifact sequences: adapters, primers, homopolymers and simple repeats."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Published adapter and primer sequences, needed as they are for equal results.
ADAPTERS = [
    ("PrimerDimer", "AATGATACGGCGACCACCGAGATCTACACTCTTTCCCTACACGACGCTCTTCCGAGATCGGAAGAGCGGTTCAGCAGGAATGCCGAGACCGATCTCGTATGCCGTCTTCTGCTTG"),
    ("RNA_Linker", "ATCTCGTATGCCGTCTTCTGCTTGATCTCGTATGCCGTCTTCTGCTTG"),
    ("Homopolymer-A", "A" * 64),
    ("Homopolymer-C", "C" * 64),
    ("Solexa_5_prime_adapter", "AATGATACGGCGACCACCGACAGGTTCAGAGTTCTACAG"),
    ("Solexa_3_prime_adapter", "TTTTCGTATGCCGTCTTCTGCTTG"),
    ("Gex_Adapter_1", "GATCGTCGGACTGTAGAACTCTGAAC"),
    ("Gex_Adapter_1_2", "ACAGGTTCAGAGTTCTACAGTCCGAC"),
    ("Gex_Adapter_2", "CAAGCAGAAGACGGCATACGANN"),
    ("Gex_Adapter_2_2", "TCGTATGCCGTCTTCTGCTTG"),
    ("Gex_PCR_Primer_1", "CAAGCAGAAGACGGCATACGA"),
    ("Gex_PCR_Primer_2", "AATGATACGGCGACCACCGACAGGTTCAGAGTTCTACAGTCCGA"),
    ("Gex_Sequencing_Primer", "CGACAGGTTCAGAGTTCTACAGTCCGACGATC"),
    ("Adapters1", "GATCGGAAGAGCTCGTATGCCGTCTTCTGCTTG"),
    ("Adapters1_1", "ACACTCTTTCCCTACACGACGCTCTTCCGATCT"),
    ("PCR_Primers1", "AATGATACGGCGACCACCGAGATCTACACTCTTTCCCTACACGACGCTCTTCCGATCT"),
    ("PCR Primers1_1", "CAAGCAGAAGACGGCATACGAGCTCTTCCGATCT"),
    ("Genomic_DNA_Sequencing_Primer", "ACACTCTTTCCCTACACGACGCTCTTCCGATCT"),
    ("PE_Adapters1", "GATCGGAAGAGCGGTTCAGCAGGAATGCCGAG"),
    ("PE_Adapters1_", "ACACTCTTTCCCTACACGACGCTCTTCCGATCT"),
    ("PE_PCR_Primers1", "AATGATACGGCGACCACCGAGATCTACACTCTTTCCCTACACGACGCTCTTCCGATCT"),
    ("PE_PCR_Primers1_1", "CAAGCAGAAGACGGCATACGAGATCGGTCTCGGCATTCCTGCTGAACCGCTCTTCCGATCT"),
    ("PE_Sequencing_Primer", "ACACTCTTTCCCTACACGACGCTCTTCCGATCT"),
    ("PE_Sequencing_Primer_1", "CGGTCTCGGCATTCCTGCTGAACCGCTCTTCCGATCT"),
]

# Units of the simple repeats; each is repeated to REPEAT_BASES.
REPEAT_UNITS = (
    "CA CAA CAAA CAAAA CAAAAA CAAAC CAAAG CAAAT CAACC CAACG CAACT CAAG CAAGA CAAGC CAAGG CAAGT CAAT CAATA CAATC CAATG CAATT CACAA CACAC CACAG "
    "CACAT CACCC CACCG CACCT CACG CACGA CACGC CACGT CACTA CACTC CACTG CACTT CAG CAGA CAGAA CAGAC CAGAG CAGAT CAGC CAGCC CAGCG CAGCT CAGG CAGGA "
    "CAGGC CAGGG CAGGT CAGT CAGTA CAGTC CAGTT CAT CATA CATAA CATAC CATAG CATAT CATCC CATCG CATCT CATG CATGC CATGT CATTA CATTC CATTT CCAA CCCA "
    "CCCCG CCCGA CCGCG CCGCT CCGG CCGAA CCGAG CCGGA CCGGG CCGTA CCTAA CCTAG CCTAT CCTCG CG CGA CGAA CGAAA CGAAG CGAAT CGACG CGAG CGAGA CGAGG "
    "CGAGT CGAT CGATA CGG CGGA CGGG CGGAA CGGAG CGGGA CGGT CGTAA CGTAG CTAA CTAG CTAAA CTAAG CTAAT CTACT CTAGG CTAGT CTATA CTATT CTTAT CTTTA "
    "GA GAA GAAA GAAAA GAGAA GGA GGAA GGAAA GGAGA GGGA GGGAA GGGGA TA TATAA TAA TAAA TAAAA TAAG TACG TAG TAGA TAGG TAGGG TGAA TGAG TGG TGGA "
    "TTAA TTAAA TTAAG CACCAT CCCGAA CCCCAA CCCCAG CCCTAA GAAAAA TAAAAA GGAGAA GGGAGA TGGGGG CGGGGG AGGGGG CAGAGA"
).split()
REPEAT_BASES = 120
# Fixed value: a satellite unit, four times in a row; it comes before the units of six bases.
SATELLITE = ("SUBTEL_sat#Satellite", "GCGCCTCTCTGCGCCTGCGCCGGCGCSSC", 4)


#: Artifacts are taken as circles in windows of this length.
CIRCULAR = 24


def artifact_rows(repeats: bool = True, circular: int = 0) -> list[tuple[int, str, str, str]]:
    """``(artifact_id, name, kind, seq)``; the first ``circular`` bases come again at the end, so that windows of that length run on."""
    rows = [(name, "adapter", seq) for name, seq in ADAPTERS]
    if repeats:
        made = [(f"({u})n#Simple_repeat", "repeat", (u * REPEAT_BASES)[:REPEAT_BASES]) for u in REPEAT_UNITS]
        at = REPEAT_UNITS.index("CACCAT")
        name, unit, times = SATELLITE
        rows += [*made[:at], (name, "repeat", unit * times), *made[at:]]
    return [(i, name, kind, seq + seq[:circular]) for i, (name, kind, seq) in enumerate(rows)]


#: Ids of control genomes, then of reference sequences, start here.
CONTROL_ID, REFERENCE_ID = 500_000, 1_000_000


def artifacts(spark: SparkSession, repeats: bool = True, reference_fasta: str | None = None, control_fasta: str | None = None, circular: int = 0) -> DataFrame:
    """The artifact table, with files of further artifacts (kind ``reference``, linear) and of control genomes such as PhiX (``control``, circular as the rest)."""
    from pyspark.sql import functions as F

    from strandworks.functions import dna
    from strandworks.sources import fastx

    table = spark.createDataFrame(artifact_rows(repeats, circular), "artifact_id int, name string, kind string, seq string")
    for path, kind, first, extra in ((control_fasta, "control", CONTROL_ID, circular), (reference_fasta, "reference", REFERENCE_ID, 0)):
        if path is not None:
            more = fastx.read_fasta(spark, path)
            table = table.unionByName(more.select((F.lit(first) + F.col("read_id")).cast("int").alias("artifact_id"), "name", F.lit(kind).alias("kind"), dna.circularize("seq", extra).alias("seq")))
    return table
