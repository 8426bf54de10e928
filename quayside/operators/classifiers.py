"""Classifier factories.

These five are Spark ML estimators: each iteration or tree level is one
distributed aggregate (``treeAggregate`` of gradients or split histograms)
and only the model travels between driver and executors.  The remaining
four classifiers (C2 discriminant, C5 nearest neighbours, C7 extra trees,
C8 second-order boosting) have their own modules, built from DataFrame
aggregates, and plug into the same ``Pipeline``.
"""

from __future__ import annotations

from pyspark.ml.classification import (DecisionTreeClassifier, LinearSVC,
                                       LogisticRegression,
                                       NaiveBayes, RandomForestClassifier)


def logistic(maxIter: int = 100, regParam: float = 0.0, tol: float = 1e-6, features="features",
             label="label") -> LogisticRegression:
    """Logistic regression (L-BFGS on distributed gradients)."""
    return LogisticRegression(maxIter=maxIter, regParam=regParam, tol=tol,
                              featuresCol=features, labelCol=label)


def gaussian_nb(features="features", label="label") -> NaiveBayes:
    """Gaussian naive Bayes (one pass of per-class moments)."""
    return NaiveBayes(modelType="gaussian", featuresCol=features, labelCol=label)


def linear_svm(maxIter: int = 100, regParam: float = 0.01, tol: float = 1e-6,
               standardization: bool = True, features="features", label="label") -> LinearSVC:
    """C4: linear support vector machine (hinge loss, OWL-QN).

    The kernel is not stated for this capability; a linear SVM is the form
    that scales by distributed gradients.  Keep ``regParam > 0`` and scaled
    features: unregularised runs on weak features can stall.
    """
    return LinearSVC(maxIter=maxIter, regParam=regParam, tol=tol,
                     standardization=standardization, featuresCol=features, labelCol=label)


def random_forest(numTrees: int = 20, maxDepth: int = 5, seed: int = 7, maxBins: int = 32,
                  bootstrap: bool = True, featureSubsetStrategy: str = "auto",
                  features="features", label="label") -> RandomForestClassifier:
    """Random forest (bootstrap rows, feature subsets, best splits)."""
    return RandomForestClassifier(numTrees=numTrees, maxDepth=maxDepth, seed=seed,
                                  maxBins=maxBins, bootstrap=bootstrap,
                                  featureSubsetStrategy=featureSubsetStrategy,
                                  featuresCol=features, labelCol=label)


def decision_tree(maxDepth: int = 5, seed: int = 7, maxBins: int = 32, features="features",
                  label="label") -> DecisionTreeClassifier:
    """CART decision tree with Gini impurity.  With more ``maxBins`` than
    a feature has values, every midpoint between two values is a candidate."""
    return DecisionTreeClassifier(maxDepth=maxDepth, seed=seed, impurity="gini", maxBins=maxBins,
                                  featuresCol=features, labelCol=label)
