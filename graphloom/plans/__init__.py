"""Plan building blocks shared by the operators: scratch tables and fixpoint loops."""
