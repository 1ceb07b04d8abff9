"""What each checkpoint of a single-cell study can test; a report lists those that it has no record of as not run."""

from __future__ import annotations

# Names of checks, by checkpoint, with what they test.
FETCH = {"file size": "the size is the expected one", "file sha256": "the checksum is the reference's, or is recorded", "gzip stream": "the file decompresses to its end"}
ASSEMBLE = {
    "unique cell IDs": "no identifier occurs twice",
    "cell ID sets match metadata": "matrix and metadata are about the same cells",
    "column order vs metadata": "labels in the matrix file agree with the metadata column by column",
    "NaN/inf values": "no value is missing or infinite",
    "negative values": "no value is negative, unless the data are scaled",
    "detected scale": "counts, linear TPM, a log scale, or something else",
    "scale matches declaration": "the scale found is the one declared",
    "published numbers": "shape and label counts are those that were published",
}
QC = {
    "mito genes found": "there are mitochondrial genes to filter by",
    "mito signal present": "those genes carry signal, so the filter can work",
    "filters": "how many cells each filter removes",
    "total cells removed": "all filters together remove no more than the limit",
    "per-sample loss": "no sample loses more than the limit",
}
FEATURES = {
    "method matches scale": "the values can be normalised from the scale they are on",
    "per-cell totals comparable": "all cells have about the same linear total afterwards",
    "finite and non-negative values": "the transform makes no missing, infinite or negative values",
    "sparsity preserved": "no zeros became values",
    "input values kept": "the given values are still there",
    "depth spread across samples": "median depth is of one order in all samples",
    "dominant-gene cells": "few cells consist of one gene",
    "HVG count": "as many variable genes as asked for, each once",
    "technical genes among HVGs": "mitochondrial, ribosomal and haemoglobin genes are few among them",
    "low-detection HVGs": "they are seen in enough cells",
    "HVG stability (two halves)": "two halves of the cells choose alike",
    "batch robustness": "they vary in at least half of the batches",
    "mean expression coverage": "they aren't mostly from the lowest tenth of expression",
}
DIMRED = {
    "PCA on selected genes": "components of the scaled selected genes are finite",
    "number of PCs chosen from the data": "the fewest components that hold a share of the real structure",
    "variance threshold reached": "that share is reached within the components computed",
    "chosen PCs beat shuffled data": "each component kept exceeds what shuffled genes give",
    "PCs driven by technical covariates": "components kept aren't mostly depth, detection or mitochondrial share",
    "batch structure in PCs": "how much of the components kept the batch explains",
    "batch correction effect": "correction lowers that and mixes neighbours",
    "neighbor graph fragments": "few cells sit in tiny pieces of the graph",
    "UMAP finite": "the two-dimensional picture is finite",
}
CLUSTER = {
    "representation used": "clusters come from the components chosen before, corrected if need be",
    "resolution chosen from the data": "the finest resolution that is stable and whose neighbours differ",
    "chosen resolution is stable": "resamples of 80 % of the cells find the clusters again",
    "cluster count": "the number of clusters is plausible",
    "no tiny clusters": "no cluster is too small",
    "no dominant cluster": "no cluster holds most cells",
    "per-cluster stability": "each cluster is found again",
    "neighboring clusters distinguishable": "clusters side by side differ by enough genes",
    "cluster markers": "each cluster has marker genes",
    "batch mixing within clusters": "no cluster is nearly all of one batch",
}
ANNOTATE = {
    "marker panel": "each type has enough positive markers in the data",
    "panel strength": "no type rests on one marker",
    "enough usable markers": "each type keeps three detectable markers, or all it was given",
    "sparse panel genes": "genes too rarely seen are set aside and named",
    "negative markers": "genes that must be off are given or suggested",
    "annotation tiers": "how sure the names are",
    "cells named": "most cells are in named clusters",
    "negative marker conflicts": "no named cluster has its type's negative genes on",
    "data-driven marker support": "the clusters' own markers include some of the panel's",
    "reference agreement": "a labelled reference gives the same names",
    "same type in several clusters": "clusters that share a name are listed",
    "panel types not found": "types that no cluster has are listed",
    "pretrained annotation tools": "names of a pretrained model are compared",
}
COMPARE = {
    "groups": "two conditions, both with cells",
    "replicates": "enough independent samples for each condition",
    "pairing": "samples seen in both conditions are compared with themselves",
    "condition vs batch": "condition and batch can be told apart",
    "clusters follow condition": "no cluster is nearly all of one condition",
    "cell types follow condition": "no type is nearly all of one condition",
    "testable cell types": "types with enough cells in enough samples",
    "unlabelled cells": "few cells are without a name",
    "abundance": "shares of types differ by two models that agree",
    "differential expression": "genes differ on totals of samples, not on cells",
    "null check": "swapped labels find next to nothing",
    "sample consistency": "called genes move one way in most samples",
    "state change": "the condition shows in samples a classifier hasn't seen",
    "pathway enrichment": "ranked results are tested against gene sets",
    "transcription factor activity": "not built: needs a regulator network",
    "cell-cell communication": "not built: needs a ligand-receptor resource",
    "spatial association": "needs positions of the cells",
    "gene modules": "modules that change with the condition",
}
INTERPRET = {
    "gene sets": "a usable collection of sets is loaded",
    "background": "sets are tested against the genes seen, not the genome",
    "pathway analysis": "markers are tested for over-representation, corrected",
    "pre-ranked enrichment": "a ranked result is tested against the sets",
    "gene programs": "restarts find the same programs",
    "expectations": "known biology is found, controls are quiet",
    "signature validation": "a signature holds in samples it wasn't made from",
    "robustness: clusters": "clusters survive other settings",
    "robustness: cell-type calls": "names survive other settings",
    "robustness: pathways": "terms survive other settings",
    "caveats carried": "earlier warnings are carried into the conclusions",
}
CATALOGUES = {"fetch": FETCH, "assemble": ASSEMBLE, "qc": QC, "features": FEATURES, "dimred": DIMRED, "cluster": CLUSTER, "annotate": ANNOTATE, "compare": COMPARE, "interpret": INTERPRET}
