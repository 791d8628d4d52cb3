"""Column layouts of the engine's tables, as DDL."""

READ = "read_id BIGINT, file_id INT, name STRING, comment STRING, seq STRING, qual STRING, discarded BOOLEAN, pair_key STRING, read_num INT"
KMER_OBS = "read_id BIGINT, pos INT, kmer STRING, is_fwd BOOLEAN, weight DOUBLE, left STRING, left_q INT, right STRING, right_q INT"
SPECTRUM = "kmer STRING, n BIGINT, w DOUBLE, n_fwd BIGINT"
TRIM = "read_id BIGINT, trim_offset INT, trim_length INT, score DOUBLE, label STRING, available BOOLEAN"
SAM = "qname STRING, flag INT, rname STRING, pos INT, mapq INT, cigar STRING, rnext STRING, pnext INT, tlen INT, seq STRING, qual STRING, tags MAP<STRING,STRING>"
